"""Normalised records: names without legal forms, squashed and as skeletons; addresses as canonical tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NON_LATIN, fold, squash, tokens, transliterate

# Legal forms, domain endings, abbreviations and states.
LEGAL = "inc incorporated llc llp lp ltd limited pvt private pte corp corporation co company plc gmbh sarl sas sa eurl sasu sci ets ag bv nv opc and the".split()
LEGAL_SPOKEN = "praivet praivat privet limitd limitid".split()
LEGAL_SPELLED = "elelpi elelp elp praa li praibet praiveet pirai piraiveet".split()
ENDINGS = r"(?:com|net|org|in|co\.in|fr|io|biz|info|us|co|shop|store|online)"
ABBREVIATIONS = {
    "rd": "road", "st": "street", "dr": "drive", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "ln": "lane", "ct": "court", "hwy": "highway", "pkwy": "parkway", "cir": "circle", "pl": "place",
    "ter": "terrace", "sq": "square", "ste": "suite", "fl": "floor", "flr": "floor", "bldg": "building", "nr": "near", "opp": "opposite", "mkt": "market", "ctr": "center", "centre": "center", "na": "", "nan": "", "null": "",
}
ABBREVIATIONS_OF = {"France": {"r": "rue", "bd": "boulevard", "chem": "chemin", "imp": "impasse", "zi": "zone", "za": "zone", "pl": "place", "av": "avenue", "cc": "centre", "ctre": "centre"}}
STATES = {
    "US": {
        "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct", "delaware": "de", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id",
        "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms",
        "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv", "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm", "new york": "ny", "north carolina": "nc", "north dakota": "nd", "ohio": "oh",
        "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa", "rhode island": "ri", "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va",
        "washington": "wa", "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy", "district of columbia": "dc",
    },
    "India": {
        "andhra pradesh": "ap", "arunachal pradesh": "ar", "assam": "as", "bihar": "br", "chhattisgarh": "cg", "goa": "ga", "gujarat": "gj", "haryana": "hr", "himachal pradesh": "hp", "jharkhand": "jh", "karnataka": "ka",
        "kerala": "kl", "madhya pradesh": "mp", "maharashtra": "mh", "manipur": "mn", "meghalaya": "ml", "mizoram": "mz", "nagaland": "nl", "odisha": "od", "orissa": "od", "punjab": "pb", "rajasthan": "rj", "sikkim": "sk",
        "tamil nadu": "tn", "telangana": "ts", "tripura": "tr", "uttar pradesh": "up", "uttarakhand": "uk", "uttaranchal": "uk", "west bengal": "wb", "delhi": "dl", "jammu and kashmir": "jk", "ladakh": "la",
        "chandigarh": "ch", "puducherry": "py", "pondicherry": "py", "andaman and nicobar islands": "an", "lakshadweep": "ld", "dadra and nagar haveli": "dn", "daman and diu": "dd", "gurugram": "gurgaon",
    },
}


def squashed(word: str) -> str:
    """squash() of one word, in Python."""
    import re

    from ..functions.text import SQUASH

    for a, b in SQUASH:
        word = word.replace(a, b)
    return re.sub(r"([a-z])\1+", r"\1", word)


LEGAL_SQUASHED = sorted({squashed(w) for w in LEGAL} | set(LEGAL_SPOKEN))


def without(words: Column, stop: list[str]) -> Column:
    """words that aren't in stop; all of them if none is left."""
    kept = F.filter(words, lambda t: ~t.isin(stop))
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def _looked_up(word: Column, table: dict[str, str]) -> Column:
    if not table:
        return word
    return F.coalesce(F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[word], word)


def _by_country(country: Column, special: dict[str, Column], usual: Column) -> Column:
    out = usual
    for name, value in special.items():
        out = F.when(country == name, value).otherwise(out)
    return out


def normalize(records: DataFrame, unicode: bool = False) -> DataFrame:
    """country and the derived columns of records (id, name, addr, country); a null name or address counts as empty.

    unicode: other scripts are respelled and all Unicode marks folded by Arrow functions; else only Latin accents are
    folded, within Catalyst.
    """
    df = records.select("country", "id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("addr", F.lit("")).alias("addr"))
    df = df.withColumn("_spelled", F.col("name").rlike(NON_LATIN))
    if unicode:
        df = df.withColumns({c: transliterate(F.col(c)) for c in ("name", "addr")})
    name, domain = F.trim(F.lower("name")), rf"^(?:www\.)?([a-z0-9\-]+)\.{ENDINGS}$"
    df = df.withColumn("is_domain", name.rlike(domain))
    name = F.when(F.col("is_domain"), F.regexp_extract(name, domain, 1)).otherwise(name)
    name = F.replace(F.regexp_replace(name, r"\bm/s\b\.?", " "), F.lit("."), F.lit(""))
    # Steps that are used more than once are columns, which the optimizer then evaluates once.
    df = df.withColumn("_w", tokens(F.regexp_replace(fold(name, unicode), "[^a-z0-9]+", " ")))
    df = df.withColumn("name_norm", F.array_join(without(F.col("_w"), LEGAL), " "))
    df = df.withColumn("_w", tokens(squash(F.col("name_norm"))))
    words = F.col("_w")
    plain = without(words, LEGAL_SQUASHED)
    df = df.withColumn("name_toks", F.when(F.col("_spelled"), without(words, LEGAL_SQUASHED + LEGAL_SPELLED)).otherwise(plain) if unicode else plain)
    df = df.withColumns({"name_sq": F.array_join("name_toks", " "), "name_core": F.array_join("name_toks", ""), "name_skel": F.transform("name_toks", lambda t: F.regexp_replace(t, "[aeiou]+", ""))})

    addr = F.regexp_replace(F.regexp_replace(F.lower("addr"), r"\bn/a\b", " "), r"[.\-/,;:#()\[\]]", " ")
    addr = F.concat(F.lit(" "), F.regexp_replace(fold(addr, unicode), "[^a-z0-9 ]+", " "), F.lit(" "))
    df = df.withColumn("_addr", addr)
    chains = {}
    for country, table in STATES.items():
        value = F.col("_addr")
        for long, short in table.items():
            if " " in long:
                value = F.regexp_replace(value, f"(?<= ){long}(?= )", short)
        chains[country] = value
    df = df.withColumn("_words", tokens(_by_country(F.col("country"), chains, F.col("_addr"))))

    def canonical(country: str | None) -> Column:
        single = {k: v for k, v in STATES.get(country, {}).items() if " " not in k}
        short = ABBREVIATIONS | ABBREVIATIONS_OF.get(country, {})
        return F.transform("_words", lambda t: F.regexp_replace(_looked_up(_looked_up(t, single), short), r"^0+(\d)", "$1"))

    words = _by_country(F.col("country"), {c: canonical(c) for c in sorted({*STATES, *ABBREVIATIONS_OF})}, canonical(None))
    df = df.withColumn("addr_toks", F.filter(words, lambda t: t != ""))
    df = df.withColumns(
        {
            "addr_norm": F.array_join("addr_toks", " "),
            "addr_missing": F.size("addr_toks") == 0,
            "addr_nums": F.slice(F.filter("addr_toks", lambda t: t.rlike("[0-9]")), 1, 3),
            "addr_alpha": F.filter("addr_toks", lambda t: t.rlike("^[a-z]{3,}$")),
        }
    )
    return df.drop("_spelled", "_addr", "_words", "_w")

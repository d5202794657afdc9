"""The same results as matchloom.queries in DuckDB's SQL, for comparison."""

from __future__ import annotations

from .functions.text import ACCENTED, LIGATURES, PLAIN, SQUASH
from .operators.blocking import CANDIDATES, CAP_LEAST, CAP_SHARE, FAMILIES, MORE_FAMILIES
from .operators.normalize import ABBREVIATIONS, ABBREVIATIONS_OF, ENDINGS, LEGAL, LEGAL_SQUASHED, STATES
from .operators.precision import LOCALITY_LEAST, NOISE
from .plans.universe import ENTITIES, RECORDS, TRUTH


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def words_in(words: list[str]) -> str:
    return "(" + ", ".join(map(text, words)) + ")"


def bucket(x: str, salt: str, m: int) -> str:
    return f"(('0x' || substr(md5({x} || '{salt}'), 1, 8))::bigint % {m})"


def fold(x: str) -> str:
    x = f"lower({x})"
    for a, b in LIGATURES.items():
        x = f"replace({x}, {text(a)}, {text(b)})"
    return f"translate({x}, '{ACCENTED}', '{PLAIN}')"


def squash(x: str) -> str:
    for a, b in SQUASH:
        x = f"replace({x}, '{a}', '{b}')"
    for c in "abcdefghijklmnopqrstuvwxyz":
        x = f"regexp_replace({x}, '{c}{c}+', '{c}', 'g')"
    return x


def tokens(x: str) -> str:
    return f"list_filter(string_split(trim(regexp_replace({x}, '\\s+', ' ', 'g')), ' '), lambda t: t <> '')"


def without(words: str, stop: list[str]) -> str:
    kept = f"list_filter({words}, lambda t: t not in {words_in(stop)})"
    return f"case when len({kept}) > 0 then {kept} else {words} end"


def looked_up(x: str, table: dict[str, str]) -> str:
    return f"case {x} " + " ".join(f"when {text(a)} then {text(b)}" for a, b in table.items()) + f" else {x} end" if table else x


def norm(source: str, name: str) -> str:
    """CTEs that end in one called name."""
    dom = rf"^(?:www\.)?([a-z0-9\-]+)\.{ENDINGS}$"
    chain = "case country " + " ".join(f"when '{c}' then " + _states(c) for c in STATES) + " else a end"
    words = "case country " + " ".join(f"when '{c}' then {_canonical(c)}" for c in sorted({*STATES, *ABBREVIATIONS_OF})) + f" else {_canonical(None)} end"
    return rf"""
{name}_1 as (select country, id, coalesce(name, '') as name, coalesce(addr, '') as addr, trim(lower(coalesce(name, ''))) as n from {source}),
{name}_2 as (select *, regexp_matches(n, '{dom}') as is_domain from {name}_1),
{name}_3 as (select *, replace(regexp_replace(case when is_domain then regexp_extract(n, '{dom}', 1) else n end, '\bm/s\b\.?', ' ', 'g'), '.', '') as m,
  ' ' || regexp_replace({fold(r"regexp_replace(regexp_replace(lower(addr), '\bn/a\b', ' ', 'g'), '[.\-/,;:#()\[\]]', ' ', 'g')")}, '[^a-z0-9 ]+', ' ', 'g') || ' ' as a from {name}_2),
{name}_4 as (select *, {tokens(f"regexp_replace({fold('m')}, '[^a-z0-9]+', ' ', 'g')")} as t, {tokens(chain)} as aw from {name}_3),
{name}_5 as (select *, array_to_string({without('t', LEGAL)}, ' ') as name_norm, list_filter({words}, lambda t: t <> '') as addr_toks from {name}_4),
{name}_6 as (select *, {tokens(squash('name_norm'))} as st from {name}_5),
{name}_7 as (select *, {without('st', LEGAL_SQUASHED)} as name_toks from {name}_6),
{name} as (select country, id, name, addr, is_domain, name_norm, name_toks, array_to_string(name_toks, ' ') as name_sq, array_to_string(name_toks, '') as name_core,
  list_transform(name_toks, lambda t: regexp_replace(t, '[aeiou]+', '', 'g')) as name_skel, addr_toks, array_to_string(addr_toks, ' ') as addr_norm, len(addr_toks) = 0 as addr_missing,
  list_filter(addr_toks, lambda t: regexp_matches(t, '[0-9]'))[1:3] as addr_nums, list_filter(addr_toks, lambda t: regexp_matches(t, '^[a-z]{{3,}}$')) as addr_alpha from {name}_7)"""


def _states(country: str) -> str:
    x = "a"
    for _ in range(2):  # the space between two states belongs to both
        for long, short in STATES[country].items():
            if " " in long:
                x = f"replace({x}, ' {long} ', ' {short} ')"
    return x


def _canonical(country: str | None) -> str:
    single = {k: v for k, v in STATES.get(country, {}).items() if " " not in k}
    short = ABBREVIATIONS | ABBREVIATIONS_OF.get(country, {})
    first = f"list_transform(aw, lambda t: {looked_up('t', single)})"
    return f"list_transform(list_transform({first}, lambda t: {looked_up('t', short)}), lambda t: regexp_replace(t, '^0+([0-9])', '\\1'))"


UNIVERSE = f"e as ({ENTITIES}),\nrec as ({RECORDS}),\ngt as ({TRUTH})"
NORM = UNIVERSE + "," + norm("e", "n1") + "," + norm("rec", "n2")


def _long(words: str, n: int) -> str:
    return f"list_filter({words}, lambda t: length(t) >= {n})"


def _pairs(words: str) -> str:
    return f"flatten(list_transform({words}, lambda x: list_transform(list_filter({words}, lambda y: x < y), lambda y: x || '|' || y)))"


def _product(a: str, b: str) -> str:
    return f"flatten(list_transform({a}, lambda x: list_transform({b}, lambda y: x || '|' || y)))"


NUMBERS = f"list_distinct(list_concat(list_transform(addr_nums, lambda x: right(x, 4)), list_transform({_long('addr_nums', 4)}, lambda x: right(x, 3))))"
FAMILY = {
    "n": _long("name_toks", 3),
    "s": _long("name_skel", 3),
    "p": "case when length(name_core) >= 5 then [substr(name_core, 1, 5)] else [] end",
    "c": "case when length(name_core) >= 6 then [name_core] else [] end",
    "a": _long("addr_alpha", 4),
    "b": _pairs(f"({_long('name_toks', 3)})[1:6]"),
    "h": _product(NUMBERS, "addr_alpha"),
    "m": _product(NUMBERS, _long("name_toks", 3)),
    "z": "case when length(name_core) >= 6 then [array_to_string(list_sort(list_filter(string_split(name_core, ''), lambda c: c <> '')), '')] else [] end",
    "k": _pairs("(list_filter(name_skel, lambda t: t <> ''))[1:5]"),
    "w": "case when length(array_to_string(name_skel, '')) >= 4 then [array_to_string(name_skel, '')] else [] end",
}


def keys(source: str, families: tuple[str, ...] = FAMILIES) -> str:
    return " union all ".join(f"select distinct country, id, '{f}' as fam, unnest({FAMILY[f]}) as key from {source}" for f in families)


BLOCKS = f"""{NORM},
k1 as ({keys('n1')}), k2 as ({keys('n2')}),
nc as (select country, count(*) as n from n2 group by 1),
d1 as (select country, fam, key, count(*) as df1 from k1 group by all), d2 as (select country, fam, key, count(*) as df from k2 group by all),
kw as (select d2.*, d1.df1, ln(1 + n::double / df) as w from d2 join d1 using (country, fam, key) join nc using (country)
       where df <= greatest({CAP_LEAST}, floor({CAP_SHARE}::double * n)) and df1 <= greatest({CAP_LEAST}, floor({CAP_SHARE}::double * n))),
h1 as (select k1.country, id as s1, fam, key, w from k1 join kw using (country, fam, key)), h2 as (select k2.country, id as r, fam, key, w from k2 join kw using (country, fam, key)),
s1w as (select country, s1, sum(w) as ws from h1 group by all), s2w as (select country, r, sum(w) as wr from h2 group by all),
pr as (select h1.country, s1, r, sum(h1.w) as score, count(*) as nk, {', '.join(f"sum(case when fam = '{f}' then h1.w else 0 end) as w_{f}" for f in FAMILIES)} from h1 join h2 using (country, fam, key) group by all),
bp as (select pr.*, ws, wr, score / sqrt(ws * wr) as cos from pr join s1w using (country, s1) join s2w using (country, r)),
bk as (select * from (select *, row_number() over (partition by country, s1 order by round(cos, 9) desc, r) as rank from bp) where rank <= {CANDIDATES})"""

SCORED = f"""{BLOCKS},
sc as (select country, s1, r, cos, {bucket("s1 || '|' || r", 'p1', 10000)} / 10000.0::double as p1, {bucket("s1 || '|' || r", 'p2', 10000)} / 10000.0::double as p2,
       {bucket("s1 || '|' || r", 'ce', 10000)} / 10000.0::double as ce from bk)"""

NKEY = lambda x: f"array_to_string(list_sort({tokens(x)}), ' ')"
KEYED = f"""{SCORED},
sk as (select id, addr_nums[1] as num, nullif({NKEY('name_norm')}, '') as nkey, case when not addr_missing then addr_norm end as akey from n1),
rk as (select id, addr_nums[1] as num, nullif({NKEY('name_norm')}, '') as nkey, case when not addr_missing then addr_norm end as akey from n2),
kd as (select sc.*, sk.num as sn1, rk.num as rn1, rk.nkey as rk, rk.akey as ra from sc left join sk on sk.id = s1 left join rk on rk.id = r)"""

_CWORDS = f"list_filter({tokens('name_norm')}, lambda t: t not in {words_in(NOISE)} and not regexp_matches(t, '^[0-9]+$'))"
_COMPS = "list_filter(list_transform(string_split(lower(addr), ','), lambda x: trim(regexp_replace(regexp_replace(x, '[^a-z ]+', ' ', 'g'), '\\s+', ' ', 'g'))), lambda x: length(x) >= 3)"


def clean(source: str) -> str:
    return f"(select country, id, {_CWORDS} as ctoks, array_to_string(list_sort({_CWORDS}), ' ') as ckey, {_COMPS} as comps, addr_nums[1] as num1, case when not addr_missing then addr_norm end as akey from {source})"


CLEAN = f"{NORM},\nc1 as {clean('n1')},\nc2 as {clean('n2')}"


def close(a: str, b: str) -> str:
    return f"({a} = {b} or jaro_winkler_similarity({a}, {b}) >= 0.85 or levenshtein({a}, {b}) <= case when length({a}) <= 4 then 1 else 2 end)"


def novel(known: str, words: str) -> str:
    alone = f"len(list_filter({known}, lambda k: {close('w', 'k')})) = 0"
    return f"len(list_filter({words}, lambda w: length(w) >= 3 and not regexp_matches(w, '^[0-9]+$') and {alone}))"


def jaccard(a: str, b: str) -> str:
    return f"case when len({a}) > 0 and len({b}) > 0 then len(list_intersect({a}, {b}))::double / len(list_distinct(list_concat({a}, {b}))) end"


def contain(a: str, b: str) -> str:
    return f"case when len({a}) > 0 and len({b}) > 0 then len(list_intersect({a}, {b}))::double / least(len(list_distinct({a})), len(list_distinct({b}))) end"


def decoded(p: str, tau: str, gate: str, source: str = "sc") -> str:
    return f"""select country, s1, r, p from (select *, max(p) over (partition by s1) as top from (select * from (select country, s1, r, {p} as p, max({p}) over (partition by r) as best from {source} where {p} >= {tau}) where p = best)) where top >= {gate}"""


def f05(matches: str, weight: str = "1") -> str:
    """CTE fe: the score of every entity for matches (s1, r)."""
    return f"""fm as (select distinct s1, r from ({matches})), ft as (select distinct s1, r from gt), fo as (select distinct r from gt),
ff as (select fm.s1, sum(case when fo.r is null then {weight} else 1 end)::double as nf, count(ft.r) as tp from fm left join ft using (s1, r) left join fo on fo.r = fm.r group by 1),
fn as (select s1, count(*) as nt from ft group by 1),
fe as (select e.country, e.id as s1, coalesce(tp, 0) as tp, coalesce(nt, 0) as nt, coalesce(nf, 0) as nf,
       case when coalesce(nt, 0) = 0 and coalesce(nf, 0) = 0 then 1.0::double else 1.25::double * coalesce(tp, 0) / (0.25::double * coalesce(nt, 0) + coalesce(nf, 0)) end as f05 from e left join ff on ff.s1 = e.id left join fn on fn.s1 = e.id)"""


def context(p: str, prefix: str, half: str) -> str:
    w = "over (partition by s1)"
    return f"""row_number() over (partition by s1 order by {p} desc, r) as {prefix}_rank_s1, round(max({p}) {w}, 6) as {prefix}_max_s1, round({p} - max({p}) {w}, 6) + 0.0::double as {prefix}_gap_s1,
coalesce(nth_value({p}, 2) over (partition by s1 order by {p} desc, r rows between unbounded preceding and unbounded following), 0) as {prefix}_2nd_s1, round(sum({p}) {w}, 6) as {prefix}_sum_s1, (count(*) filter ({half}) {w})::bigint as {prefix}_n50_s1"""


def others(key: str, value: str | None = None) -> str:
    made = f"count(*) over (partition by s1, {key}) - 1" if value is None else f"round(sum({value}) over (partition by s1, {key}) - {value}, 6) + 0.0::double"
    return f"case when {key} is not null then ({made})::double end"


_STACK = f"""so as (select s1, r, dn_sim, {bucket("s1 || '|' || r", 'p1', 10000)} / 10000.0::double as p1, {bucket("s1 || '|' || r", 'p2', 10000)} / 10000.0::double as p2, {bucket("s1 || '|' || r", 'ce', 10000)} / 10000.0::double as ce from tk where dn_rank <= 3),
sn as (select s1, r, dn_sim, {bucket("s1 || '|' || r", 'p1', 10000)} / 10000.0::double as p1, null::double as p2, {bucket("s1 || '|' || r", 'ce', 10000)} / 10000.0::double as ce
       from (select *, row_number() over (partition by s1 order by dn_sim desc, r) as k from tk where dn_sim >= 0.2 and not exists (select 1 from so where so.s1 = tk.s1 and so.r = tk.r)) where k <= 5),
tr as (select tk.s1, tk.r from tk join embeddings a on a.vec_id::varchar = tk.s1 join embeddings b on b.vec_id::varchar = tk.r where a.label = b.label),
st as (select s1, r, is_new, p1, dn_sim, ce, coalesce(dn_rank, 11)::double as dn_rank, case when p2 >= 0.3 then p2 else 0.0::double end as p2c
       from (select *, 0 as is_new from so union all select *, 1 from sn) left join (select s1, r, dn_rank from tk) using (s1, r))"""


def with_(ctes: str, query: str) -> str:
    """The query behind the shared CTEs; a query that begins with a comma goes on with CTEs of its own."""
    return f"with {ctes}\n{query}"


ROUND = "round({0}, 6) as {0}".format
#: What the linkage must reach on records that its models have not seen.
FLOORS = {"recall of candidates": 0.95, "macro F0.5": 0.9, "average precision": 0.9}
TAUS, GATES = (0.3, 0.5, 0.7, 0.9), (0.0, 0.5, 0.8)
SPEC = {"US": (0.5, 0.6), "India": (0.7, 0.0)}
DEFAULT = (0.6, 0.65)

_SETS = {
    "nm_core_eq": "case when a.name_core = b.name_core and a.name_core <> '' then 1.0 else 0.0 end",
    "nm_tok_jac": jaccard("a.name_toks", "b.name_toks"),
    "nm_tok_contain": contain("a.name_toks", "b.name_toks"),
    "nm_skel_jac": jaccard("a.name_skel", "b.name_skel"),
    "len_a": "length(a.name_core)",
    "len_b": "length(b.name_core)",
    "ntok_a": "len(a.name_toks)",
    "ntok_b": "len(b.name_toks)",
    "len_ratio": "least(length(a.name_core), length(b.name_core))::double / greatest(length(a.name_core), length(b.name_core), 1)",
    "dom_a": "a.is_domain::int",
    "dom_b": "b.is_domain::int",
    "first_tok_eq": "coalesce((a.name_toks[1] = b.name_toks[1])::int, 0)",
    "prefix4_eq": "(substr(a.name_core, 1, 4) = substr(b.name_core, 1, 4) and a.name_core <> '')::int",
    "ad_miss_b": "b.addr_missing::int",
    "ad_ntok_b": "len(b.addr_toks)",
    "ad_ntok_a": "len(a.addr_toks)",
}
_FOURS = tuple(f"list_transform({s}.addr_nums, lambda x: right(x, 4))" for s in "ab")
_THREES = tuple(f"list_transform({_long(f'{s}.addr_nums', 3)}, lambda x: right(x, 3))" for s in "ab")
_ADDR = {
    "ad_alpha_jac": jaccard("a.addr_alpha", "b.addr_alpha"),
    "ad_alpha_inter": "len(list_intersect(a.addr_alpha, b.addr_alpha))",
    "ad_alpha_contain": contain("a.addr_alpha", "b.addr_alpha"),
    "ad_num_jac": jaccard("a.addr_nums", "b.addr_nums"),
    "ad_num_first_eq": "case when len(a.addr_nums) > 0 and len(b.addr_nums) > 0 then (a.addr_nums[1] = b.addr_nums[1])::int end",
    "ad_num_t4": f"case when len(a.addr_nums) > 0 and len(b.addr_nums) > 0 then list_has_any({_FOURS[0]}, {_FOURS[1]})::int end",
    "ad_num_t3": f"case when len({_THREES[0]}) > 0 and len({_THREES[1]}) > 0 then list_has_any({_THREES[0]}, {_THREES[1]})::int end",
    "ad_num_inter": "len(list_intersect(a.addr_nums, b.addr_nums))",
    "ad_last_eq": "coalesce((a.addr_toks[-1] = b.addr_toks[-1])::int, 0)",
}
SET_COLUMNS = [f"round(({v})::double, 6) as {k}" for k, v in _SETS.items()] + [f"round((case when not a.addr_missing and not b.addr_missing then {v} end)::double, 6) as {k}" for k, v in _ADDR.items()]
def lcs(a: str, b: str) -> str:
    """Longest common subsequence by rows of its table; characters as lists of their code, so that all parts have one type."""
    row = f"list_transform(range(1, length({b}) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i: greatest(row[i + 1], row[i] + case when substr({b}, i::int, 1) = chr(c[1]::int) then 1 else 0 end))))"
    codes = f"list_transform(string_split({a}, ''), lambda x: [unicode(x)::bigint])"
    return f"case when {a} = '' or {b} = '' then 0 else list_last(list_reduce({codes}, lambda row, c: list_concat([0::bigint], {row}), list_transform(range(0, length({b}) + 1), lambda x: 0::bigint))) end"


def indel(a: str, b: str) -> str:
    return f"case when {a} = '' and {b} = '' then 1.0::double else 2.0::double * ({lcs(a, b)}) / (length({a}) + length({b})) end"


def osa(a: str, b: str) -> str:
    """Edits with swaps, by rows, each character in two steps.

    The state is the row before, the row, the last character's code and place, and what a step passes to the next.
    """
    swap = f"case when s[3][2] >= 1 and j >= 2 and substr({b}, (j - 1)::int, 1) = chr(c[1][1]::int) and substr({b}, j::int, 1) = chr(s[3][1]::int) then s[1][j - 1] + 1 else 100000 end"
    cells = f"list_concat([s[3][2] + 1], list_transform(range(1, length({b}) + 1), lambda j: least(s[2][j + 1] + 1, s[2][j] + case when substr({b}, j::int, 1) = chr(c[1][1]::int) then 0 else 1 end, {swap})))"
    row = "list_transform(range(1, len(s[4]) + 1), lambda j: list_min(list_transform(range(1, j + 1), lambda k: s[4][k] + j - k)))"
    codes = f"flatten(list_transform(string_split({a}, ''), lambda x: [[[unicode(x)::bigint, 0]], [[unicode(x)::bigint, 1]]]))"
    first = f"[list_transform(range(0, length({b}) + 1), lambda x: 0::bigint), range(0, length({b}) + 1), [0::bigint, 0], [0::bigint]]"
    both = f"case when c[1][2] = 0 then [s[1], s[2], s[3], {cells}] else [s[2], {row}, [c[1][1], s[3][2] + 1], [0::bigint]] end"
    return f"case when {a} = '' then length({b}) when {b} = '' then length({a}) else list_last(list_reduce({codes}, lambda s, c: {both}, {first})[2]) end"


def monge(a: str, b: str) -> str:
    like = "case when x = y then 1.0::double else jaro_winkler_similarity(x, y) end"
    return f"case when len({a}) > 0 and len({b}) > 0 then list_avg(list_transform({a}, lambda x: list_max(list_transform({b}, lambda y: {like})))) end"


def _sorted_words(x: str) -> str:
    return f"array_to_string(list_sort({tokens(x)}), ' ')"


def token_set(name: str, a: str, b: str, source: str) -> str:
    """CTEs that end in one called name: source with <name>_v, the best ratio of shared words and either side's own."""
    return f"""
{name}_0 as (select *, list_distinct({tokens(a)}) as x, list_distinct({tokens(b)}) as y from {source}),
{name}_1 as (select *, array_to_string(list_sort(list_intersect(x, y)), ' ') as sh, array_to_string(list_sort(list_filter(x, lambda t: not list_contains(y, t))), ' ') as le,
        array_to_string(list_sort(list_filter(y, lambda t: not list_contains(x, t))), ' ') as ri from {name}_0),
{name}_2 as (select *, trim(sh || ' ' || le) as ab, trim(sh || ' ' || ri) as ba from {name}_1),
{name}_3 as (select *, case when {a} is null or {b} is null then null when len(x) = 0 or len(y) = 0 then 0.0::double when sh <> '' and (le = '' or ri = '') then 1.0::double end as plain from {name}_2),
{name}_4 as (select *, case when plain is null and {a} is not null and {b} is not null then {indel('ab', 'ba')} end as base from {name}_3),
{name} as (select * exclude (x, y, sh, le, ri, ab, ba, plain, base), coalesce(plain, case when sh = '' then base else greatest(base, 2.0::double * length(sh) / (length(sh) + least(length(ab), length(ba)))) end) as {name}_v from {name}_4)"""


JOINED = "from bk join n1 a on a.id = bk.s1 join n2 b on b.id = bk.r"


def _extra() -> str:
    """CTEs xf and xr: the further features of pairs, and ratios of different sorted address words."""
    full = [f"list_filter({x}.name_skel, lambda t: t <> '')" for x in "ab"]
    ends = "list_transform(a.addr_nums, lambda m: list_transform(b.addr_nums, lambda n: (length(m) >= 3 and length(n) >= 3 and (ends_with(m, n) or ends_with(n, m)))::int))"
    alike = "list_transform(a.addr_nums, lambda m: list_transform(b.addr_nums, lambda n: 1 - levenshtein(m, n)::double / greatest(length(m), length(n))))"
    cover = "list_filter(a.name_toks, lambda t: list_contains(list_transform(b.name_toks, lambda u: substr(u, 1, 3)), substr(t, 1, 3)))"
    known, numbers = "not a.addr_missing and not b.addr_missing", "len(a.addr_nums) > 0 and len(b.addr_nums) > 0"
    joined = [f"case when len(a.addr_alpha) > 0 and len(b.addr_alpha) > 0 then array_to_string(list_sort({x}.addr_alpha), ' ') end" for x in "ab"]
    columns = {
        "known": known, "fa": joined[0], "fb": joined[1],
        "tri_jac": jaccard(_grams("a.name_core", 3), _grams("b.name_core", 3)), "bi_jac": jaccard(_grams("a.name_core", 2), _grams("b.name_core", 2)),
        "me_ab": monge("a.name_toks", "b.name_toks"), "me_ba": monge("b.name_toks", "a.name_toks"), "skel_me": monge(*full),
        "pre3_cover": f"case when len(a.name_toks) > 0 and len(b.name_toks) > 0 then len({cover})::double / len(a.name_toks) end",
        "len_diff": "abs(length(a.name_core) - length(b.name_core))::double", "skel_first_eq": "coalesce(a.name_skel[1] = b.name_skel[1], false)::int::double",
        "ad_me_ab": f"case when {known} then {monge('a.addr_alpha', 'b.addr_alpha')} end", "ad_me_ba": f"case when {known} then {monge('b.addr_alpha', 'a.addr_alpha')} end",
        "ad_num_sim": f"case when {known} and {numbers} then list_max(flatten({alike})) end", "ad_num_suffix": f"case when {known} and {numbers} then list_max(flatten({ends}))::double end",
        "ad_common": f"case when {known} then len(list_intersect(a.addr_toks, b.addr_toks))::double / greatest(1, least(len(list_distinct(a.addr_toks)), len(list_distinct(b.addr_toks)))) end",
        "ad_jw": f"case when {known} then case when a.addr_norm = b.addr_norm then 1.0::double else jaro_winkler_similarity(a.addr_norm, b.addr_norm) end end",
    }
    made = ", ".join(f"{c} as {n}" for n, c in columns.items())
    return f"xf as (select bk.country, s1, r, {made} {JOINED}), xd as (select distinct fa, fb from xf where fa is not null), xr as (select fa, fb, {indel('fa', 'fb')} as ratio from xd)"


def _v3() -> str:
    """CTEs of the features against false matches, behind c1 and c2: vf, ts, vr (of different names), u, w, m1, m2."""

    def covered(name: str, own: str, other: str) -> str:
        near = f"len(list_filter(list_slice({other}, 1, 10), lambda k: k = t or jaro_winkler_similarity(t, k) >= 0.92)) > 0"
        return f"""
{name} as (select s1, r, sum(case when hit then wt else 0.0::double end) / greatest(0.000001::double, sum(wt)) as cov, coalesce(max(case when not hit then wt end), 0.0::double) as miss, coalesce(max(case when hit then wt end), 0.0::double) as most
       from (select s1, r, list_contains({other}, t) or {near} as hit, coalesce(idf, mi) as wt from (select vp.country, s1, r, unnest({own}) as t, {other} from vp) left join ti using (country, t) join mt using (country)) group by s1, r)"""

    def free(a: str, b: str) -> str:
        return f"len(list_filter({a}, lambda x: len(list_filter({b}, lambda y: x = y or jaro_winkler_similarity(x, y) >= 0.9)) = 0))"

    locs = "select country, id, list_sort(list(loc)) as locs from (select country, id, unnest(list_distinct(comps)) as loc from {0}) join lv using (country, loc) group by country, id"
    return f""",
lv as (select country, loc from (select country, id, unnest(list_distinct(comps)) as loc from c1) group by all having count(*) >= {LOCALITY_LEAST}),
l1 as ({locs.format('c1')}), l2 as ({locs.format('c2')}),
ti as (select country, t, ln((n + 1)::double / (df + 1)) as idf from (select country, t, count(*) as df from (select country, unnest(list_distinct(ctoks)) as t from c1) group by all) join (select country, count(*) as n from c1 group by 1) using (country)),
mt as (select country, max(idf) as mi from ti group by country),
m1 as (select country, ckey, ln(1 + count(*)) as log_n from c1 where ckey <> '' group by all), m2 as (select country, ckey, ln(1 + count(*)) as log_n from c2 where ckey <> '' group by all),
vp as (select bk.country, s1, r, c1.ctoks as t1, c1.ckey as k1, c2.ctoks as t2, c2.ckey as k2 from bk join c1 on c1.id = s1 join c2 on c2.id = r),
vf as (select vp.*, len(t1) > 0 and len(t2) > 0 as b_, {jaccard('t1', 't2')} as cn_jac, coalesce(len(l1.locs), 0) as loc_n1, coalesce(len(l2.locs), 0) as loc_n2, len(l1.locs) > 0 and len(l2.locs) > 0 as kn,
       {free('l1.locs', 'l2.locs')} as f1, {free('l2.locs', 'l1.locs')} as f2 from vp left join l1 on l1.id = s1 left join l2 on l2.id = r),
vd as (select distinct k1 as p, k2 as q from vp where len(t1) > 0 and len(t2) > 0), vr as (select p, q, {indel('p', 'q')} as ratio from vd), {token_set('ts', 'p', 'q', 'vd')},{covered('u', 't1', 't2')},{covered('w', 't2', 't1')}"""


def _grams(x: str, n: int) -> str:
    return f"case when length({x}) > 0 then list_distinct(list_transform(range(1, greatest(1, length({x}) - {n} + 1) + 1), lambda i: substr({x}, i, {n}))) else [] end"


ORACLES = {
    "norm_name": with_(NORM, "select * from (select country, id, is_domain, name_norm, name_sq, name_core, array_to_string(name_skel, ' ') as skel from n1 union all select country, id, is_domain, name_norm, name_sq, name_core, array_to_string(name_skel, ' ') from n2)"),
    "norm_addr": with_(NORM, "select country, id, addr_norm, addr_missing, array_to_string(addr_nums, ' ') as nums, array_to_string(addr_alpha, ' ') as alpha from (select * from n1 union all select * from n2)"),
    **{f"key_{f}": with_(NORM, keys("n2", (f,))) for f in (*FAMILIES, *MORE_FAMILIES)},
    "key_df_pruned": with_(BLOCKS, "select country, fam, key, df, df1 from kw"),
    "key_idf": with_(BLOCKS, "select country, fam, key, round(w, 6) as w from kw"),
    "block_pairs": with_(BLOCKS, f"select country, s1, r, round(score, 6) as score, nk, {', '.join(ROUND(f'w_{f}') for f in FAMILIES)}, round(ws, 6) as ws, round(wr, 6) as wr, round(cos, 6) as cos from bp"),
    "block_topk": with_(BLOCKS, "select country, s1, r, nk, round(score, 6) as score, round(cos, 6) as cos, rank from bk"),
    "block_recall_at_k": with_(BLOCKS, "select k, round(avg(case when rank <= k then 1.0::double else 0 end), 6) as recall from gt left join bk using (s1, r), (select unnest([5, 10, 20, 40, 60, 100])::int as k) group by k"),
    "reduction_ratio": with_(BLOCKS, "select country, m as pairs, round(1 - m::double / (a * b), 9) as ratio from (select country, count(*) as m from bk group by 1) join (select country, count(*) as a from n1 group by 1) using (country) join (select country, count(*) as b from n2 group by 1) using (country)"),
    "record_top3": with_(BLOCKS, "select r, count(*) as n_s1_for_r, " + ", ".join(f"round(coalesce(list_sort(list(cos), 'desc')[{k}], 0), 6) as t{k}" for k in (1, 2, 3)) + " from bk group by r"),
    "record_context": with_(BLOCKS, """, rb as (select s1, r, round(cos, 9) as cos from bk) select s1, r, round(cos / max(cos) over (partition by s1), 6) as cos_rel_s1, round(cos - max(cos) over (partition by s1), 6) + 0.0::double as cos_gap_s1, count(*) over (partition by s1) as n_cand, n as n_s1_for_r,
round(t[1], 6) as cos_top1_r, round(cos - comp, 6) + 0.0::double as cos_margin_r, round(cos / (comp + 1e-6::double), 3) as cos_ratio_r, (1 + (t[1] > cos)::int + (coalesce(t[2], 0) > cos)::int + (coalesce(t[3], 0) > cos)::int)::bigint as cos_rank_r
from (select *, case when cos >= t[1] then coalesce(t[2], 0) else t[1] end as comp from rb join (select r, count(*) as n, list_sort(list(cos), 'desc') as t from rb group by r) using (r))"""),
    "set_features": with_(BLOCKS, f"select s1, r, {', '.join(SET_COLUMNS)} {JOINED}"),
    "ngram_jaccard": with_(BLOCKS, f"select s1, r, round({jaccard(_grams('a.name_core', 3), _grams('b.name_core', 3))}, 6) as tri_jac, round({jaccard(_grams('a.name_core', 2), _grams('b.name_core', 2))}, 6) as bi_jac {JOINED}"),
    "jaro_winkler": with_(BLOCKS, f"select s1, r, round(case when a.name_core = b.name_core then 1 else jaro_winkler_similarity(a.name_core, b.name_core) end, 6) as nm_jw {JOINED}"),
    "fuzz_ratio": with_(BLOCKS, f"select s1, r, round({indel('a.name_sq', 'b.name_sq')}, 6) as nm_ratio, round({indel('a.name_core', 'b.name_core')}, 6) as nm_core_ratio {JOINED}"),
    "token_sort": with_(f"{BLOCKS}, so as (select s1, r, {_sorted_words('a.name_sq')} as x, {_sorted_words('b.name_sq')} as y {JOINED})", f"select s1, r, round({indel('x', 'y')}, 6) as nm_tsort from so"),
    "token_set": with_(f"{BLOCKS}, tp as (select s1, r, a.name_sq as p, b.name_sq as q {JOINED}), {token_set('ts', 'p', 'q', 'tp')}", "select s1, r, round(ts_v, 6) as nm_tset from ts"),
    "osa": with_(BLOCKS, f"select s1, r, ({osa('a.name_core', 'b.name_core')})::bigint as nm_osa {JOINED}"),
    "monge_elkan": with_(BLOCKS, f"select s1, r, round({monge('a.name_toks', 'b.name_toks')}, 6) as me_ab, round({monge('b.name_toks', 'a.name_toks')}, 6) as me_ba {JOINED}"),
    "levenshtein_sim": with_(BLOCKS, f"select s1, r, round(1 - levenshtein(a.name_sq, b.name_sq)::double / greatest(length(a.name_sq), length(b.name_sq), 1), 6) as lev {JOINED}"),
    "split_folds": with_(UNIVERSE, f"select id as s1, (floor({bucket('id', '43', 100)} / 20))::bigint as fold, {bucket('id', '43', 100)} < 20 as is_val, {bucket('id', '53', 2)}::bigint as half from e"),
    "density_drop": with_(SCORED, f"select s1, r from sc where {bucket('s1', '47', 100)} >= 19"),
    "hash_sample": with_(UNIVERSE, f"select id, {bucket('id', '42', 10000)} < 2500 as in_entities, {bucket('id', '49', 10000)}::bigint as unowned_bucket from rec"),
    "anchors": with_(KEYED, """, ac as (select s1, r as ra, p1 as pa from (select *, row_number() over (partition by s1 order by p1 desc, r) as k from sc where p1 >= 0.9) where k <= 3)
select s1, r, count(*) as anc_n, max(pa) as anc_p_max, round(max(case when a.name_core = b.name_core then 1 else jaro_winkler_similarity(a.name_core, b.name_core) end), 6) as anc_name_jw_max,
max(case when a.addr_nums[1] is not null and b.addr_nums[1] is not null then (a.addr_nums[1] = b.addr_nums[1])::int end)::double as anc_num_eq from sc join ac using (s1) join n2 a on a.id = r join n2 b on b.id = ra where p1 >= 0.02 and r <> ra group by s1, r"""),
    "extra_features": with_(f"{BLOCKS}, {_extra()}", """select country, s1, r, round(tri_jac, 6) as tri_jac, round(bi_jac, 6) as bi_jac, round(me_ab, 6) as me_ab, round(me_ba, 6) as me_ba, round(least(me_ab, me_ba), 6) as me_min,
        round(skel_me, 6) as skel_me, round(pre3_cover, 6) as pre3_cover, len_diff, skel_first_eq, round(ad_me_ab, 6) as ad_me_ab, round(ad_me_ba, 6) as ad_me_ba, round(least(ad_me_ab, ad_me_ba), 6) as ad_me_min,
        round(ad_num_sim, 6) as ad_num_sim, ad_num_suffix, round(ad_common, 6) as ad_common, round(ad_jw, 6) as ad_jw, round(case when known and fa is not null then ratio end, 6) as ad_alpha_ratio from xf left join xr using (fa, fb)"""),
    "v3_features": with_(BLOCKS + f",\nc1 as {clean('n1')},\nc2 as {clean('n2')}" + _v3(), """select vf.country, s1, r, case when b_ then (k1 = k2)::int::double end as cn_eq, round(case when b_ then ts_v end, 6) as cn_tset, round(case when b_ then ratio end, 6) as cn_ratio,
        round(cn_jac, 6) as cn_jac, round(case when b_ then u.cov end, 6) as cn_cov1, round(case when b_ then w.cov end, 6) as cn_cov2, round(case when b_ then u.miss end, 6) as cn_miss_idf1, round(case when b_ then w.miss end, 6) as cn_miss_idf2,
        round(case when b_ then u.most end, 6) as cn_max_idf_match, loc_n1, loc_n2, case when kn then loc_n1 - f1 end as loc_inter, case when kn then f1 end as loc_unm1, case when kn then f2 end as loc_unm2,
        case when kn then (f1 > 0 and f2 > 0)::int end as loc_conflict, round(coalesce(x1.log_n, 0), 6) as n_s1_same1, round(coalesce(x2.log_n, 0), 6) as n_s1_same2, round(coalesce(x3.log_n, 0), 6) as n_c_same2
        from vf left join ts on k1 = ts.p and k2 = ts.q left join vr on k1 = vr.p and k2 = vr.q left join u using (s1, r) left join w using (s1, r)
        left join m1 x1 on x1.country = vf.country and x1.ckey = k1 left join m1 x2 on x2.country = vf.country and x2.ckey = k2 left join m2 x3 on x3.country = vf.country and x3.ckey = k2"""),
    "anchor_features": with_(KEYED, f""", ac as (select s1, r as ra, p1 as pa from (select *, row_number() over (partition by s1 order by p1 desc, r) as k from sc where p1 >= 0.9) where k <= 3),
ap as (select s1, r, pa, a.name_sq as p, b.name_sq as q, a.name_core as ca, b.name_core as cb, a.addr_nums[1] as na, b.addr_nums[1] as nb,
       case when not a.addr_missing and not b.addr_missing then a.addr_norm end as da, case when not a.addr_missing and not b.addr_missing then b.addr_norm end as db
       from sc join ac using (s1) join n2 a on a.id = r join n2 b on b.id = ra where p1 >= 0.02 and r <> ra),
dp as (select distinct p, q from ap), {token_set('tn', 'p', 'q', 'dp')}, de as (select distinct da, db from ap where da is not null), {token_set('ta', 'da', 'db', 'de')}
select s1, r, count(*) as anc_n, max(pa) as anc_p_max, round(max(tn_v), 6) as anc_name_max, round(max(case when ca = cb then 1 else jaro_winkler_similarity(ca, cb) end), 6) as anc_name_jw_max, round(max(ta_v), 6) as anc_addr_max,
max(case when na is not null and nb is not null then (na = nb)::int end)::double as anc_num_eq from ap left join tn using (p, q) left join ta using (da, db) group by s1, r"""),
    "stage2_context": with_(SCORED, f"""select s1, r, {context('p1', 'p', 'p1 > 0.5').replace('p_n50_s1', 'n_gt50_s1')}, n_gt50_r, p_sum_r, t[1] as p_top1_r, round(p1 - comp, 6) + 0.0::double as p_margin_r, round(p1 / (comp + 1e-6::double), 3) as p_ratio_r
from (select *, case when p1 >= t[1] then coalesce(t[2], 0) else t[1] end as comp from sc join (select r, (count(*) filter (p1 > 0.5))::bigint as n_gt50_r, round(sum(p1), 6) as p_sum_r, list_sort(list(p1), 'desc') as t from sc group by r) using (r))"""),
    "sibling_support": with_(KEYED, f"""select s1, r, case when rn1 is not null and sn1 is not null then (rn1 = sn1)::int::double end as num_eq, {others('rn1')} as sup_num_r, {others('rk')} as sup_name_r, {others('ra')} as sup_addr_r, {others('rn1', 'p1')} as sup_num_r_w,
{others('ra', 'p1')} as sup_addr_r_w, coalesce(sum(case when rn1 is not null and sn1 is not null then (rn1 = sn1)::int::double end) over (partition by s1), 0) as sup_num_s1 from kd"""),
    "stage3_context": with_(KEYED, f"""select s1, r, {context('p2', 'p2', 'p2 >= 0.5')}, {others('rn1', 'p2')} as p2_num_w, {others('ra', 'p2')} as p2_addr_w, {others('rk', 'p2')} as p2_name_w,
round(sum(case when rn1 = sn1 then p2 else 0 end) over (partition by s1), 6) as p2_s1num_w, round(p2 / (sum(p2) over (partition by s1) + 1e-6::double), 6) as p2_share from kd"""),
    "record_competition": with_(SCORED, """, li as (select s1, r, count(*) over w as r_n, row_number() over (partition by r order by p1 desc, s1) as r_rank, round(sum(p1) over w, 6) as r_sum, p1, nth_value(p1, 2) over (partition by r order by p1 desc, s1 rows between unbounded preceding and unbounded following) as p_2, max(p1) over w as p_1
from sc where p1 >= 0.02 window w as (partition by r)), an as (select r, count(*) as r_n_any from li group by r)
select sc.s1, sc.r, coalesce(r_n, 0) as r_n, coalesce(r_rank, 0) as r_rank, coalesce(r_sum, 0) as r_sum, coalesce(case when r_rank = 1 then coalesce(p_2, 0) else p_1 end, 0) as r_other, coalesce(r_n_any, 0) as r_n_any from sc left join li on li.s1 = sc.s1 and li.r = sc.r left join an on an.r = sc.r"""),
    "stacker_context": with_(SCORED, """select s1, r, p2c, row_number() over (partition by s1 order by p2c desc, r) as p2_rank_s1, count(*) over (partition by s1) as n_cand, row_number() over (partition by s1 order by ce desc, r) as ce_rank_s1, max(ce) over (partition by s1) as ce_max_s1,
round(ce - max(ce) over (partition by s1), 6) + 0.0::double as ce_gap_s1, round(sum(ce) over (partition by s1), 6) as ce_sum_s1 from (select *, case when p2 >= 0.3 then p2 else 0 end as p2c from sc)"""),
    "cleaned_key": with_(CLEAN, "select country, id, ckey, array_to_string(comps, '|') as comps, num1, akey from (select * from c1 union all select * from c2)"),
    "locality_vocab": with_(CLEAN, f"select country, loc, count(*) as n from (select country, id, unnest(list_distinct(comps)) as loc from c1) group by all having n >= {LOCALITY_LEAST}"),
    "localities": with_(CLEAN, f", v as (select country, loc, count(*) as n from (select country, id, unnest(list_distinct(comps)) as loc from c1) group by all having n >= {LOCALITY_LEAST})\nselect country, id, string_agg(loc, '|' order by loc) as locs from (select country, id, unnest(list_distinct(comps)) as loc from c2) join v using (country, loc) group by country, id"),
    "token_idf": with_(CLEAN, "select country, t, df, round(ln((n + 1)::double / (df + 1)), 6) as idf from (select country, t, count(*) as df from (select country, unnest(list_distinct(ctoks)) as t from c1) group by all) join (select country, count(*) as n from c1 group by 1) using (country)"),
    "name_frequency": with_(CLEAN, "select country, ckey, count(*) as n, round(ln(1 + count(*)), 6) as log_n from c2 where ckey <> '' group by all"),
    "noise_vocab": with_(CLEAN, f"select word, count(*) as n from (select c1.ctoks, unnest(list_distinct(c2.ctoks)) as word from (select s1, r from gt union select 'P' || substr(id, 2), id from rec where id like 'U%') q join c1 on c1.id = s1 join c2 on c2.id = r) where length(word) >= 3 and not regexp_matches(word, '^[0-9]+$') and len(list_filter(ctoks, lambda k: {close('word', 'k')})) = 0 group by word having count(*) >= 8"),
    "twin_flags": with_(KEYED + f",\nc1 as {clean('n1')},\nc2 as {clean('n2')}", f""", nv as (select kd.s1, kd.r, rn1, sn1, ra, {novel('c1.ctoks', 'c2.ctoks')} as nov_r, {novel('c2.ctoks', 'c1.ctoks')} as miss_r from kd join c1 on c1.id = kd.s1 join c2 on c2.id = kd.r),
tw as (select *, case when rn1 is not null then max(nov_r) over (partition by s1, rn1) end as grp_nov_num, case when ra is not null then max(nov_r) over (partition by s1, ra) end as grp_nov_addr, case when rn1 is not null then (count(*) filter (nov_r > 0) over (partition by s1, rn1))::bigint end as grp_novn_num from nv)
select s1, r, nov_r, miss_r, grp_nov_num, grp_nov_addr, grp_novn_num, coalesce(rn1 <> sn1 and grp_nov_num > 0, false) as twin_flag from tw"""),
    "decode_one_owner": with_(SCORED, "select s1, r, p2 as p from (select *, max(p2) over (partition by r) as best from sc where p2 >= 0.5) where p2 = best"),
    "decode_gate": with_(SCORED, f"select s1, r, p from ({decoded('p2', '0.5', '0.8')})"),
    "decode_country_spec": with_(SCORED, "select s1, r, p from (" + " union all ".join(decoded("p2", str(t), str(g), f"(select * from sc where country {c})") for c, (t, g) in [*((f"= '{c}'", v) for c, v in SPEC.items()), (f"not in {words_in(list(SPEC))}", DEFAULT)]) + ")"),
    "decode_rescue": with_(SCORED, "select s1, r, p2 as p from sc join n1 a on a.id = s1 join n2 b on b.id = r where p2 >= 0.7 or p2 >= 0.3 and a.name_norm = b.name_norm and a.name_norm <> ''"),
    "decode_hybrid": with_(SCORED, f"select s1, r, p from ({decoded('p2', '0.5', '0')}) where country <> 'France' union all select s1, r, p from ({decoded('p1', '0.6', '0.7')}) where country = 'France'"),
    "twin_rule": with_(KEYED + f",\nc1 as {clean('n1')},\nc2 as {clean('n2')}", f""", nv as (select kd.s1, kd.r, rn1, sn1, {novel('c1.ctoks', 'c2.ctoks')} as nov_r from kd join c1 on c1.id = kd.s1 join c2 on c2.id = kd.r),
tw as (select *, max(nov_r) over (partition by s1, rn1) as g from nv)
select q.s1, q.r, p from ({decoded('p2', '0.5', '0')}) q join tw on tw.s1 = q.s1 and tw.r = q.r where not coalesce(rn1 <> sn1 and rn1 is not null and g > 0, false)"""),
    "result_lists": with_(SCORED, f"select e.id as s1, coalesce(m, '') as matched from e left join (select s1, string_agg(r, ',' order by r) as m from ({decoded('p2', '0.5', '0')}) group by 1) q on q.s1 = e.id"),
    "candidate_lists": with_(SCORED, "select e.id as s1, coalesce(m, '') as matched from e left join (select s1, string_agg(r, ',' order by r) as m from (select s1, r from sc where p1 >= 0.5 union select s1, r from sc where ce >= 0.8) group by 1) q on q.s1 = e.id"),
    "unlisted_matches": with_(SCORED, f"select s1, r from ({decoded('p2', '0.5', '0')}) q where not exists (select 1 from sc where sc.s1 = q.s1 and sc.r = q.r and p1 >= 0.5)"),
    "macro_f05": with_(SCORED + ",\n" + f05(decoded("p2", "0.5", "0")), "select round(avg(f05), 6) as f05, count(*) as n from fe"),
    "weighted_f05": with_(SCORED + ",\n" + f05(decoded("p2", "0.5", "0"), "8"), "select round(avg(f05), 6) as f05, count(*) as n from fe"),
    "oracle_ceiling": with_(SCORED + ",\n" + f05("select s1, r from sc join gt using (s1, r)"), "select round(avg(f05), 6) as f05, count(*) as n from fe"),
    "average_precision": with_(SCORED, "select country, round(sum(hits * right_ / found) / sum(hits), 6) as ap, sum(hits)::bigint as n_true from (select country, hits, sum(n) over w as found, sum(hits) over w as right_ from (select country, p1, count(*)::double as n, count(gt.r)::double as hits from sc left join gt using (s1, r) group by 1, 2) window w as (partition by country order by p1 desc)) group by country"),
    "threshold_sweep": with_(SCORED, " union all ".join(f"select {a} as assign, {t}::double as tau, {g}::double as gate, round(avg(f05), 6) as f05 from (with {f05(decoded('p2', str(t), str(g)) if a == 'true' else f'select s1, r from (select s1, r, max(p2) over (partition by s1) as top from sc where p2 >= {t}) where top >= {g}')} select * from fe)" for a in ("true", "false") for t in TAUS for g in GATES if g >= t or g == 0)),
    "tune": with_(SCORED, "select assign, tau, gate, round(avg(f), 6) as f05 from (" + " union all ".join(f"select country, true as assign, {t}::double as tau, {g}::double as gate, avg(f05) as f from (with {f05(decoded('p2', str(t), str(g)))} select * from fe) group by country" for t in TAUS for g in GATES if g >= t or g == 0) + ") group by all"),
    "pairs_per_entity": with_(SCORED, f"select n_pairs, n_entities, round(n_pairs::double / n_entities, 6) as rate from (select count(*) as n_pairs from ({decoded('p2', '0.5', '0')})), (select count(*) as n_entities from e)"),
    "official_f05": with_(SCORED + ",\n" + f05(decoded("p2", "0.5", "0")), "select round(avg(f05), 6) as f05, count(*) as n from fe"),
    "training_pairs": with_(SCORED, "select s1, r, true as hard from gt, range(2) where not exists (select 1 from sc where sc.s1 = gt.s1 and sc.r = gt.r) union all select * from (select s1, r, false from gt where exists (select 1 from sc where sc.s1 = gt.s1 and sc.r = gt.r) order by md5(s1 || '|' || r), s1, r limit 500)"),
    "orphan_weights": with_(SCORED, "select s1, sc.r, o.r is null as orphan, case when o.r is null then 5.0::double else 1 end as w from sc left join (select distinct r from gt) o on o.r = sc.r"),
    "tsv_roundtrip": with_(UNIVERSE, "select id, name, addr, country from rec"),
    "truth_lists": with_(UNIVERSE, "select s1, r from gt"),
}

_VEC = "vq as (select vec_id::varchar as id, embedding::double[] as v from embeddings)"
_TOP = f"""{_VEC}, tk as (select * from (select *, row_number() over (partition by s1 order by dn_sim desc, r) as dn_rank from (select a.id as s1, b.id as r, round(list_cosine_similarity(a.v, b.v), 9) as dn_sim from vq a, vq b where a.id <> b.id)) where dn_rank <= 10)"""
_OLD = "od as (select * from tk where dn_rank <= 3)"
ORACLES |= {
    "stacker_union": with_(f"{_TOP}, {_STACK}", """select s1, r, is_new, dn_rank, p1, p2c, row_number() over (partition by s1 order by p2c desc, r) as p2_rank_s1, count(*) over e as n_cand,
        row_number() over (partition by s1 order by ce desc, r) as ce_rank_s1, max(ce) over e as ce_max_s1, round(dn_sim, 6) as dn_sim, round(dn_sim - max(dn_sim) over e, 6) as dn_gap_s1,
        round(ce - max(ce) over e, 6) as ce_gap_s1, round(sum(ce) over e, 6) as ce_sum_s1 from st window e as (partition by s1)"""),
    "dense_training": with_(f"{_TOP}, {_STACK}", """select s1, r, (tr.r is not null)::int as y from (select * from (select s1, r from so order by md5(s1 || '|' || r), s1, r limit 400)
        union select * from (select s1, r from sn order by md5(s1 || '|' || r), s1, r limit 300)) left join tr using (s1, r)"""),
    "dense_recall": with_(f"{_TOP}, {_STACK}", """, nr as (select s1, r, row_number() over (partition by s1 order by dn_sim desc, r) as nk from tk where dn_sim >= 0.2 and not exists (select 1 from so where so.s1 = tk.s1 and so.r = tk.r)),
        ks as (select unnest([1, 2, 3, 5, 10]) as k), ct as (select count(*) as n_true, count(*) filter (not exists (select 1 from so where so.s1 = tr.s1 and so.r = tr.r)) as missed from tr)
        select k::int as k, round(count(nr.r)::double / (select count(*) from embeddings), 6) as pairs, count(tr.r) as recovered, any_value(missed) as missed, round(1 - (any_value(missed) - count(tr.r))::double / any_value(n_true), 6) as recall
        from ks cross join ct left join nr on nk <= k left join tr on tr.s1 = nr.s1 and tr.r = nr.r group by k"""),
    "dense_by_country": """with v as (select vec_id::varchar as id, embedding::double[] as v, label from embeddings),
        p as (select a.id as s1, b.id as r, round(list_cosine_similarity(a.v, b.v), 9) as dn_sim from v a join v b using (label))
        select s1, r, round(dn_sim, 6) as dn_sim, dn_rank from (select *, row_number() over (partition by s1 order by dn_sim desc, r) as dn_rank from p) where dn_rank <= 5""",
    "link_f05": "select * from (values " + ", ".join(f"('{n}', {v}::double, true)" for n, v in FLOORS.items()) + ") t(metric, floor, reached)",
    "json_settings": "select * from (values " + ", ".join(f"('{c}', {t}::double, {g}::double)" for c, (t, g) in SPEC.items()) + ") t(country, tau, gate)",
    "word_list": with_(CLEAN, f"select distinct loc as word from (select country, id, unnest(list_distinct(comps)) as loc from c1) group by country, loc having count(*) >= {LOCALITY_LEAST}"),
    "vector_store": "select vec_id::varchar as id, len(embedding)::bigint as n, round(list_inner_product(embedding::float[]::double[], embedding::float[]::double[]), 4) as squares from embeddings",
    "stage_resume": with_(f"{NORM}, sk as ({keys('n2')})", "select country, fam, count(*) as n, count(distinct key) as n_keys, count(distinct id) as n_ids from sk where fam in ('n', 'a') group by all"),
    "norm_unicode": with_(NORM, "select country, id, name_norm, name_core, addr_norm from (select * from n1 union all select * from n2)"),
    "result_check": with_(SCORED, f""", ac as ({decoded('p2', '0.5', '0')}), ls as (select e.id as s1 from e where {bucket('e.id', 'lost', 50)} > 0),
        al as (select ac.s1, ac.r from ac join ls using (s1))
        select 'entity missing' as fault, (select count(*) from e) - (select count(*) from ls) as n union all select 'entity unknown', 0 union all select 'entity repeated', 0 union all select 'record unknown', 0
        union all select 'record repeated', 0 union all select 'match no candidate', (select count(*) from al where not exists (select 1 from sc where sc.s1 = al.s1 and sc.r = al.r and p1 >= 0.5))"""),
    "dense_topk": with_(_TOP, "select s1, r, round(dn_sim, 6) as dn_sim, dn_rank from tk"),
    "pair_cosine": with_(_TOP, "select s1, r, round(list_cosine_similarity(a.v, b.v), 6) as dn_sim from tk join vq a on a.id = s1 join vq b on b.id = r"),
    "similarity_floor": with_(_TOP, "select round(dn_sim, 6) as value from (select dn_sim, row_number() over (order by dn_sim) - 1 as k, count(*) over () as n from tk) where k = floor(0.03 * (n - 1) + 0.5)"),
    "dense_new_pairs": with_(f"{_TOP}, {_OLD}", "select s1, r, round(dn_sim, 6) as dn_sim, dn_rank from (select *, row_number() over (partition by s1 order by dn_sim desc, r) as k from tk where dn_sim >= 0.2 and not exists (select 1 from od where od.s1 = tk.s1 and od.r = tk.r)) where k <= 5"),
}

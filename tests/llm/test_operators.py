"""The training-data operators on small tables, against plain versions."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from matchloom.llm import audio, decontamination, html_extraction, licenses, mixing, pii, simhash, substring_dedup, suffix_sort, token_counts, toxicity
from matchloom.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, key string"


def frame(spark, rows):
    """documents with two further columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", s, len(t) if t else 0, "x", "y") for i, t, s in rows], DOCS)


ODD = [(1, None, None), (2, "", "a"), (3, " \t\n", "b"), (None, "null id", "a"), (4, "same words here", "a"), (4, "same words here", "a"), (5, "ünïcode ß 日本 " * 300, "é"), (6, "x" * 5000, "b")]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, []).limit(0)


def test_targets_against_resharing(spark):
    def plain(sizes, share=1.5, kinds=(3, 1, 2), most=2.0):
        names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
        weight = {s: kinds[k % 3] for k, s in enumerate(names)}
        total, fixed = share * sum(sizes.values()), set()
        target = {s: total * weight[s] / sum(weight.values()) for s in names}
        while over := [s for s in names if s not in fixed and target[s] > most * sizes[s] + 1e-9]:
            fixed.update(over)
            target |= {s: most * sizes[s] for s in over}
            free = [s for s in names if s not in fixed]
            target |= {s: (total - sum(target[x] for x in fixed)) * weight[s] / sum(weight[x] for x in free) for s in free}
        return target

    rnd = random.Random(1)
    for _ in range(4):
        sizes = {("é" if k == 3 else f"s{k}" if k else None): rnd.choice([rnd.randint(0, 50), rnd.randint(1000, 10**5)]) for k in range(rnd.randint(1, 9))}
        made = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), 1.5, (3, 1, 2), 2.0).collect()}
        assert made == pytest.approx(plain(sizes))


def test_mix(spark, odd, none):
    rows = mixing.mix_to_weights(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_to_weights(odd.repartition(3), bucket_rows=1).collect()))
    assert mixing.mix_to_weights(none).count() == 0
    many = frame(spark, [(k, "w " * (k % 7 + 1), "hot" if k % 3 else "cold") for k in range(600)])
    good = spark.createDataFrame([(k, 2.0 if k % 2 else 0.5) for k in range(600)], "doc_id long, quality double")
    taken = {r["doc_id"]: r["taken"] / r["size"] for r in mixing.mix_to_weights(many, good, share=0.5).collect()}
    assert np.mean([v for k, v in taken.items() if k % 2]) > 1.3 * np.mean([v for k, v in taken.items() if not k % 2])


PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_spliced_counts_are_those_of_whole_texts():
    model, counts = token_counts.load_tokenizer(PATH)
    rnd = random.Random(2)
    parts = ["a", " ", "\n", "'s", "'re", "1", "é", "<|endoftext|>", "<|endof", "日本", "   ", "word ", "z" * 40, " " * 50]
    for _ in range(400):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 200)))
        assert token_counts.spliced_count(model, text, rnd.choice([70, 100, 200]), rnd.choice([1, 20, 70])) == counts([text])[0]


def test_a_long_text_without_boundaries_is_not_encoded_over_and_over(monkeypatch):
    model, counts = token_counts.load_tokenizer(PATH)
    seen, plain = [], token_counts._boundaries
    monkeypatch.setattr(token_counts, "_boundaries", lambda m, text, base: seen.append(len(text)) or plain(m, text, base))
    for text in (" " * 300_000, "z" * 200_000, "word " * 60_000):
        seen.clear()
        assert token_counts.spliced_count(model, text, 4096, 256) == counts([text])[0]
        assert sum(seen) < 6 * len(text)


def test_token_counts(odd, none):
    _, counts = token_counts.load_tokenizer(PATH)
    rows = token_counts.count_tokens(odd, PATH, chunk=300, overlap=50).collect()
    want = sorted((len((t or "").encode()), counts([t])[0] if t else 0) for _, t, _ in ODD)
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in rows) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in rows) and token_counts.count_tokens(none, PATH).count() == 0


def plain_spans(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    cards = [(m, pii.only_digits(m[0])) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)]
    found += [("card", *m.span()) for m, d in cards if 16 <= len(d) <= 19 and pii.luhn(d)]
    return found + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(pii.only_digits(m[0])) <= 15]


def test_rules_against_plain_patterns():
    rnd = random.Random(3)
    parts = ["@", ".", "-", "+", "%", "a", "b2", "1", "22", "333", "0", " ", "(", ")", "é", "4111 1111", "1111", "12.34", ".com", "255", "256."]
    for _ in range(5000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text)


def test_trees_choose_further_spans():
    model, limits = pii.fit_selector()
    x, y, kinds = pii.drawn_examples(2000, seed=7)
    p = model.proba(x)
    for kind in pii.KINDS:
        own = np.array(kinds) == kind
        chosen = p[own] >= limits[kind]
        assert chosen.any() and y[own][chosen].mean() > 0.95 and chosen[y[own] == 1].mean() > 0.8


def test_further_spans_planted_in_documents(spark):
    """Recall by kind on forms planted at random places of real documents, look-alikes left alone, nothing added as they are."""
    model, limits = pii.fit_selector()
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").orderBy("doc_id").collect()] * 3
    assert all(base for spans in pii.find_spans(texts[:200], model, limits) for *_, base in spans)
    forms = {
        "email": ["Contact: jane.doe (at) mail (dot) example (dot) com", "m.müller@firma.de", "write to anna at example dot org", "info[at]site[dot]net", "mail BOB AT HOST DOT COM"],
        "ip": ["server 2001:0db8:85a3:0000:0000:8a2e:0370:7334", "fe80::1ff:fe23:4567:890a", "login from 2001:db8::ff00:42:8329"],
        "card": ["card 3782-822463-10005", "378282246310005", "Kreditkarte 4111.1111.1111.1111", "3714 496353 98431"],
        "phone": ["Tel. (030) 123-4567", "call 555-867-5309", "0049 30 1234 5678", "phone 0171 234 5678", "415.555.2671"],
    }
    like = ["2021-03-14", "12.05.2023", "192-168-55", "ISBN 978-3-16-148410", "1234567890123456", "2019 1203 4455", "meet at noon. Then", "12:30::45", "ab::cd"]
    rnd, hits, seen, wrong = random.Random(5), {}, {}, 0
    for text in texts:
        words = text.split(" ")
        at = rnd.randint(0, len(words))
        kind = rnd.choice(list(forms))
        for form, good in ((rnd.choice(forms[kind]), True), (rnd.choice(like), False)):
            whole = " ".join([*words[:at], form, *words[at:]])
            end = len(" ".join([*words[:at], form]))
            found = [s for s in pii.find_spans([whole], model, limits)[0] if s[1] < end and end - len(form) < s[2]]
            if good:
                seen[kind] = seen.get(kind, 0) + 1
                hits[kind] = hits.get(kind, 0) + any(s[0] == kind and s[2] == end for s in found)
            else:
                wrong += bool(found)
    assert all(hits[k] >= 0.9 * seen[k] for k in forms), (hits, seen)
    assert wrong <= 0.02 * len(texts)


def test_written_out_addresses_are_proposed_whatever_else_the_text_holds():
    model, limits = pii.fit_selector()
    for form in ("jane.doe at example.com", "jane.doe at example[dot]com", "jane.doe at example(dot)com", "jane.doe at example dot com", "JANE (AT) HOST (DOT) COM"):
        for text in (f"please write mail to {form}", f"please write mail to {form} by dot or (at)"):
            assert ("email", 21, 21 + len(form)) in pii.proposed_spans(text)
        spans = pii.find_spans([f"please write mail to {form}"], model, limits)[0]
        assert form.isupper() or [s[:3] for s in spans] == [("email", 21, 21 + len(form))]


def test_pii_digests_and_redaction(spark, odd, none):
    text = "call +1 (017) 555-7713 or a.b@mail.example.com, 4111 1111 1111 1111 from 10.0.0.1"
    docs = frame(spark, [(1, text, "a"), (2, "clean text of 12 words", "a"), *ODD])
    row = next(r for r in pii.digests(pii.find_pii(docs)).collect() if r["doc_id"] == 1 and r["n_card"])
    spans = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(text))
    assert row["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest() and row["spans"] == spans
    made = [r for r in pii.redact(docs).collect() if r["text"] and "<EMAIL>" in r["text"]]
    assert made[0]["text"] == "call <PHONE> or <EMAIL>, <CARD> from <IP>" and made[0]["n_chars"] == len(made[0]["text"])
    assert pii.redact(odd).columns == odd.columns and pii.redact(odd).count() == len(ODD) and pii.find_pii(none).count() == 0


def test_anchors_cover_all_links():
    rng = np.random.default_rng(0)
    prints = [rng.integers(0, 2**63, 300, dtype=np.int64)]
    for _ in range(4):
        x = prints[0].copy()
        for _ in range(rng.integers(1, 5)):
            x ^= np.int64(1) << rng.integers(0, 63, len(x))
        prints.append(x)
    prints = np.unique(np.concatenate(prints))
    keys, owners = simhash.anchors(prints)
    keys = keys >> 1 << 12 | keys & 1
    order = np.argsort(keys, kind="stable")
    place = {x: k for k, x in enumerate(prints.tolist())}
    for run in (simhash.RUN, 1):  # also with every run cut by bytes
        simhash.RUN, before = run, simhash.RUN
        u, v = simhash.link_block(keys[order], owners[order].view(np.uint64), 3)
        simhash.RUN = before
        made, want = simhash.Forest(len(prints)), simhash.Forest(len(prints))
        made.add(*(np.array([place[x] for x in y.view(np.int64).tolist()]) for y in (u, v)))
        for k in range(len(prints)):
            near = np.flatnonzero(np.bitwise_count(prints.view(np.uint64)[k] ^ prints.view(np.uint64)[k + 1 :]) <= 3) + k + 1
            want.add(np.full(len(near), k), near)
        assert (made.merge() == want.merge()).all()


def test_hot_anchors_are_split_without_losing_links(spark, monkeypatch):
    rng = np.random.default_rng(18)
    base = rng.integers(0, 2**63, 6, dtype=np.int64)
    prints = np.unique(np.concatenate([b ^ sum(np.int64(1) << rng.integers(0, 63, 150) for _ in range(rng.integers(1, 5))) for b in base] + [base[0] ^ (np.int64(1) << np.arange(32, 62))]))
    near = np.bitwise_count(prints.view(np.uint64)[:, None] ^ prints.view(np.uint64)[None, :]) <= 3
    want = simhash.Forest(len(prints))
    want.add(*np.nonzero(near))
    place = {x: k for k, x in enumerate(prints.tolist())}
    for run, most in ((3, 1 << 16), (3, 0), (2048, 0)):  # split by broadcast, split by a join, not split
        monkeypatch.setattr(simhash, "RUN", run)
        monkeypatch.setattr(simhash, "BROADCAST", most)
        links = simhash.link_fingerprints(spark.createDataFrame([(x,) for x in prints.tolist()], "fingerprint long")).collect()
        made = simhash.Forest(len(prints))
        made.add(*(np.array([place[r[c]] for r in links]) for c in "uv"))
        assert (made.merge() == want.merge()).all()


def test_simhash_components(spark, odd, none):
    import xxhash

    def plain(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", words)
        shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)] * bool(words)
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = simhash.near_duplicates(odd).collect()
    assert sorted(r["fingerprint"] & (2**64 - 1) for r in rows) == sorted(plain(t) for _, t, _ in ODD)
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "4", "5", "6", "None"]
    clash = odd.withColumnsRenamed({"lang": "ID", "source": "repeated", "size": "row", "key": "component"})
    assert simhash.deduplicate(clash).columns == clash.columns and simhash.deduplicate(clash).count() == 5
    assert simhash.near_duplicates(none).count() == 0 and simhash.deduplicate(none).count() == 0


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randint(0, 80), rnd.randint(0, 80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 230)]
    made = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {k: k for e in edges for k in e}
    for _ in root:
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    linked = {k for u, v in edges if u != v for k in (u, v)}
    assert made == {k: root[k] for k in linked}


PAGE = '<html><head><title>t</title><script>var t="</p>";</script></head><body><nav><a href="/x">Menu</a></nav><div class="ad">Buy</div>{}<div id="comments"><p>nice</div><footer>F</footer></body>'


def test_html_by_structure_and_difference(spark):
    article = PAGE.format("<article><h1>A &amp; b</h1><p>One <b>two</b>\n three<br><p>Four</article>")
    site = "<body><div>Top line</div><div>{}</div><div>Below</div></body>"
    rows = [(1, "http://h.x/a?u=1", article), (2, "http://h.x/b", article), (3, "http://s.x/1", site.format("own one")), (4, "http://s.x/2", site.format("own two")), (5, None, None), (6, "odd", ""), (None, "http://s.x/2", site.format("own two"))]
    made = {(r["page_id"], r["url"]): r["text"] for r in html_extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert made[1, "http://h.x/a?u=1"] == made[2, "http://h.x/b"] == "A & b\n\nOne two three\n\nFour"
    assert made[3, "http://s.x/1"] == "own one" and made[4, "http://s.x/2"] == "own two" and made[5, None] == "" and made[6, "odd"] == ""
    assert html_extraction.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_aligns_pages_of_articles_too(spark):
    page = "<body><nav>Menu</nav><article><p>{}</p><p>same in both</p></article><footer>Foot</footer>"
    rows = [(1, "http://h.x/a", page.format("own one, which is longer")), (2, "http://h.x/b", page.format("own two, which differs")), (3, "http://alone.x/", page.format("own three"))]
    made = {r["page_id"]: (r["text"], r["n_shared"]) for r in html_extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert made == {1: ("own one, which is longer\n\nsame in both", 2), 2: ("own two, which differs\n\nsame in both", 2), 3: ("own three\n\nsame in both", 0)}


def test_html_of_whole_pages_against_a_plain_parser(spark):
    """On the given pages, each of which has one article: the blocks of the article by the standard library's parser."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.depth, self.blocks, self.part, self.skip = 0, [], [], []

        def end_block(self):
            line = " ".join("".join(self.part).split())
            self.blocks += [line] if line else []
            self.part = []

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                self.part.append(" ")
            elif tag not in html_extraction.INLINE:
                self.end_block()
            if tag == "article":
                self.depth += 1
            own = dict(attrs)
            if self.depth and (self.skip or html_extraction.is_furniture(tag, " ".join(f'{k}="{v or ""}"' for k, v in own.items()), True) or tag in ("script", "style")) and tag not in html_extraction.VOID:
                self.skip.append(tag)

        def handle_endtag(self, tag):
            if tag not in html_extraction.INLINE:
                self.end_block()
            if tag == "article":
                self.depth -= 1
            if self.skip and self.skip[-1] == tag:
                self.skip.pop()

        def handle_data(self, data):
            if self.depth and not self.skip:
                self.part.append(data)

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    made = {r["page_id"]: r["text"] for r in html_extraction.extract_pages(pages).collect()}
    for r in pages.collect():
        plain = Article()
        plain.feed(r["html"])
        plain.close()
        plain.end_block()
        assert made[r["page_id"]] == "\n\n".join(plain.blocks), r["url"]


def test_no_article_hides_other_main_text():
    def text(page):
        lines = html_extraction.page_lines(page)
        flags, owned = html_extraction.main_flags(lines)
        return [x[0] for x, keep in zip(lines, flags, strict=True) if keep], owned

    assert text(PAGE.format("<article><p>One</article><article><p>Two, longer</article>")) == (["One", "Two, longer"], True)
    assert text(PAGE.format("<main><p>The long text of the page</p><article><p>Teaser</article></main>")) == (["The long text of the page", "Teaser"], False)
    assert text(PAGE.format("<p>By us</p><article><p>The long text of the page</article>")) == (["The long text of the page"], True)


def test_shared_lines_are_longest_subsequences():
    rnd = random.Random(5)
    for _ in range(500):
        a, b = ([rnd.randint(0, 5) for _ in range(rnd.randint(0, 20))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        made = html_extraction.shared_lines(a, b)
        rest = iter(b)
        assert len(made) == table[-1][-1] and made == sorted(set(made)) and all(a[k] in rest for k in made)


def test_suffixes_and_common_prefixes(monkeypatch, tmp_path):
    """Against plain sorting, also with queues and results on disk and batches of a few tuples."""
    rnd = random.Random(6)
    for _ in range(600):
        letters = rnd.choice([b"ab", b"abc", b"aab", bytes(range(256))])
        text = bytes(rnd.choice(letters) for _ in range(rnd.randint(0, 50))) * rnd.randint(1, 3) + b"a" * rnd.choice([0, 0, rnd.randint(1, 20)])
        monkeypatch.setattr(suffix_sort, "WINDOW", rnd.choice([1, 2, 7, 1 << 16]))
        monkeypatch.setattr(suffix_sort, "RUNS", rnd.choice([0, 1]))
        monkeypatch.setattr(suffix_sort, "BYTES", rnd.choice([0, 256]))  # by runs from the first level on
        cap = rnd.choice([1, 3, 10, 400])
        order, shared = suffix_sort.sort_suffixes(np.frombuffer(text, np.uint8), cap, str(tmp_path), rnd.choice([1, 5, 1 << 20]))
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert order.tolist() == want
        for k in range(1, len(text)):
            n = len(os.path.commonprefix([text[want[k - 1] :], text[want[k] :]]))
            assert shared[k] == n or n >= cap <= shared[k]


def test_a_shard_larger_than_what_memory_holds(tmp_path):
    """Words of a small language with copies, sorted with 1,000 numbers in memory at most and by plain sorting."""
    rnd = random.Random(16)
    words = ["".join(rnd.choice("abcde") for _ in range(rnd.randint(2, 9))) for _ in range(300)]
    text = " ".join(rnd.choice(words) for _ in range(12_000))
    text = (text + text[5000:25_000] + text[100:30_000]).encode()
    order, shared = suffix_sort.sort_suffixes(np.frombuffer(text, np.uint8), 400, str(tmp_path), 1000)
    assert isinstance(order, np.memmap) and os.listdir(tmp_path) == []
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i : i + 40_000])
    for k in rnd.sample(range(1, len(text)), 3000):
        a, b = text[order[k - 1] :][:500], text[order[k] :][:500]
        assert min(shared[k], 400) == min(len(os.path.commonprefix([a, b])), 400)


def plain_removal(texts):
    raws, seen = [(t or "").encode() for t in texts], {}
    for k, raw in enumerate(raws):
        for i in range(len(raw) - 399):
            seen.setdefault(raw[i : i + 400], []).append((k, i))
    gone = [np.zeros(len(r), bool) for r in raws]
    for places in seen.values():
        for k, i in places if len(places) > 1 else ():
            gone[k][i : i + 400] = True
    return [(len(r), int(g.sum()), int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum()), hashlib.sha256(np.frombuffer(r, np.uint8)[~g].tobytes()).hexdigest()) for r, g in zip(raws, gone)]


@pytest.mark.parametrize("hot", [6 << 20, 5000])
def test_repeats_are_removed(spark, none, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rnd = random.Random(7)
    text = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    base, common = text("abcd ", 5000), text("abcd ", 450)
    texts = [base[a : a + rnd.randint(380, 900)] + text("xyz", rnd.randint(0, 300)) for a in (rnd.randint(0, 4000) for _ in range(30))]
    texts += [text("wxyz", rnd.randint(0, 400)) + common + text("mnop", rnd.randint(0, 400)) for _ in range(40)]
    texts += ["a" * 1000, "ab" * 700, None, "", base[:399], base[:400], base[:400], "é" * 500, base[100:1200].replace("a", "b", 1)]
    rows = substring_dedup.remove_repeats(frame(spark, [(k, t, "s") for k, t in enumerate(texts)]), keep_bytes=True).collect()
    made = {r["doc_id"]: tuple(r)[1:5] for r in rows}
    assert [made[k] for k in range(len(texts))] == plain_removal(texts)
    for r in rows:
        whole = texts[r["doc_id"]]
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and r["text"] == (r["kept"].decode("utf-8", "replace") if r["n_removed"] else whole)
    assert substring_dedup.remove_repeats(none).count() == 0


def test_the_last_string_of_a_shard_finds_its_like():
    """Suffixes that are too short to be strings may follow the last string in order; they don't part it from its like."""
    rnd = random.Random(3)
    raw = b"y" + bytes(rnd.choice(b"abc") for _ in range(398)) + b"z"
    starts = substring_dedup.repeated_starts([raw, b"a" + raw], np.array([1, 3], np.uint64), np.array([0, 0]), None)
    assert starts.tolist() == [0, 401]


def test_a_repeat_of_high_bytes_keeps_its_edge(spark):
    text = "Sch " * 150 + "schüüein, " + "nichtschüüein, " * 30 + "x" * 200
    row = substring_dedup.remove_repeats(frame(spark, [(0, text, "s")])).first()
    assert tuple(row)[1:5] == plain_removal([text])[0]


def test_block_max_neighbours_are_exact():
    rng = np.random.default_rng(8)
    vectors = []
    for _ in range(500):
        terms = np.sort(rng.choice(60, rng.integers(1, 8), replace=False))
        weights = rng.random(len(terms))
        vectors.append((terms, weights / np.linalg.norm(weights)))
    index = toxicity.BlockMaxIndex(vectors, 60)
    full = np.zeros((500, 60))
    for k, (t, w) in enumerate(vectors):
        full[k, t] = w
    for q, (t, w) in enumerate(vectors[:120]):
        for leave in (-1, q):
            cos = full @ full[q]
            if leave >= 0:
                cos[leave] = 0
            order = np.lexsort((np.arange(500), -np.round(cos, 12)))[:15]
            order = order[cos[order] > 0]
            at, found = index.nearest(t, w, 15, leave)
            assert np.allclose(found, cos[order]) and len(at) == len(order)


def test_terms_little_more_frequent_in_toxic_examples_stay(spark):
    statistics = spark.createDataFrame([("strong", 400, 20), ("weak", 600, 1200), ("even", 500, 2000), ("clean", 100, 3000)], "term string, toxic long, clean long")
    assert toxicity.pick_terms(statistics, 2000, 8000) == ["strong", "weak"]


def test_whole_posting_lists_give_the_sums_of_blocks():
    rng = np.random.default_rng(14)
    terms = [np.sort(rng.choice(9, rng.integers(1, 5), replace=False)) for _ in range(3000)]
    index = toxicity.BlockMaxIndex([(t, np.full(len(t), len(t) ** -0.5)) for t in terms], 9)
    for q in range(0, 3000, 50):
        weights = np.full(len(terms[q]), len(terms[q]) ** -0.5)
        full = index.all_scores(terms[q], weights)
        assert (full == index.scores(terms[q], weights, np.arange(index.blocks))).all()
        at, found = index.nearest(terms[q], weights, 15)
        want = np.lexsort((np.arange(3000), -full))[:15]
        assert at.tolist() == want.tolist() and (found == full[want]).all()


def test_toxicity(spark, odd, none):
    rnd = random.Random(9)
    words = ["the", "house", "river", "garden", "morning", "table"] + [f"word{chr(97 + k)}" for k in range(20)]
    rows, labels = [], []
    for k in range(900):
        toxic = k % 4 == 0
        text = [rnd.choice(words) for _ in range(40)] + ([rnd.choice(["idiotic", "idiots", "scumbag", "scummy"]) for _ in range(3)] if toxic else [])
        rnd.shuffle(text)
        rows.append((k, " ".join(text), "s"))
        labels.append((k, 1, int(toxic)))
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = frame(spark, rows + [(1000 + k, t, s) for k, (_, t, s) in enumerate(ODD)])
    made = {r["doc_id"]: r for r in toxicity.score_documents(docs, labels).collect()}
    held = [made[k] for k in range(900) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(r["held_out"] for r in held) and len(held) == sum(made[k]["held_out"] for k in range(900))
    assert all((r["predicted"] == 1) == (r["doc_id"] % 4 == 0) for r in held) and all(0 <= r["score"] <= 1 for r in made.values())
    toxic = next(r for r in held if r["predicted"])
    assert toxic["evidence"] and all(e["label"] == 1 for e in toxic["evidence"][:3])
    kept = toxicity.reject_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 675 + len(ODD)
    assert toxicity.score_documents(none, labels).count() == 0
    assert {r["score"] for r in toxicity.score_documents(odd, labels.limit(0)).collect()} == {0.0}


def test_scores_against_brute_force_cosines(spark):
    """Neighbours, votes and scores of score_documents() against all cosines of plain vectors over all words."""
    rnd = random.Random(19)
    words = ["".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(2, 8))) for _ in range(150)]
    rows, labels = [], []
    for k in range(500):
        text = [rnd.choice(words) for _ in range(rnd.randint(5, 60))] + [rnd.choice(["vilest", "vilely", "nasties", "nastier"]) for _ in range(rnd.choice([0, 0, 1, 3]) if k % 5 else 4)]
        rnd.shuffle(text)
        rows.append((k, " ".join(text), "s"))
        labels.append((k, 1, int(k % 5 == 0)))
    rows += [(1000, " ".join(rnd.choice(words) for _ in range(200_000)) + " vilest", "s"), (1001, "", "s"), (1002, None, "s")]
    docs, labels = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model, _ = toxicity.fit(docs, labels)
    made = toxicity.Vectoriser(model.vocabulary)
    counts = {i: made.counts(t) for i, t, _ in rows}
    assert all(sum(n for k, n in c.items() if k == len(model.vocabulary)) <= len((t or "").split()) for (_, t, _), c in zip(rows, counts.values()))
    df = np.zeros(len(model.vocabulary) + 1)
    for c in counts.values():
        df[list(c)] += 1
    assert np.allclose(model.idf, np.log((len(rows) + 1) / (df + 1)) + 1)

    def dense(c):
        v = np.zeros(len(df))
        for k, n in c.items():
            v[k] = n**0.5 * model.idf[k]
        return v / np.linalg.norm(v)

    own = np.array([dense(counts[i]) for i in model.ids])
    found = {r["doc_id"]: r for r in toxicity.score_documents(docs, labels).collect()}
    for i, c in counts.items():
        if not model.telling(c):
            assert found[i]["score"] == pytest.approx(model.empty) and not found[i]["evidence"]
            continue
        cos = own @ dense(c)
        best = np.sort(cos)[::-1][: toxicity.NEAREST]
        assert np.allclose([e["similarity"] for e in found[i]["evidence"]], best[best > 0])
        assert all(cos[model.ids.index(e["doc_id"])] == pytest.approx(e["similarity"]) for e in found[i]["evidence"])
        w = np.array([e["similarity"] for e in found[i]["evidence"]]) ** 2
        vote = (w @ np.array([e["label"] for e in found[i]["evidence"]]) + toxicity.PRIOR * model.prior) / (w.sum() + toxicity.PRIOR)
        a, b = model.platt
        assert found[i]["score"] == pytest.approx(1 / (1 + np.exp(-(a * toxicity.logit(vote) + b))))


def test_very_long_texts(monkeypatch):
    """Texts beyond the sizes at which operators part their work."""
    rnd = random.Random(20)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    item = [word() for _ in range(30)]
    matcher = decontamination.Matcher([item])
    matcher.choose_seeds({})
    text = " ".join([word() for _ in range(200_000)] + item + [word() for _ in range(100_000)])
    hits = [m for p in matcher.passages(text) for m in matcher.matches(*p)]
    assert [(h[0], h[3], h[4]) for h in hits] == [(0, 200_000, 200_029)]
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    long_line = " ".join(word() for _ in range(3000)) + " " + notice + " " + " ".join(word() for _ in range(3000))
    assert [n[3] for n in licenses.classifier().notices(long_line)] == ["mit"]
    page = "<body><nav>Menu</nav><article>" + "".join(f"<p>{word()} {k}</p>" for k in range(20_000)) + "</article>"
    lines = html_extraction.page_lines(page)
    flags, owned = html_extraction.main_flags(lines)
    assert owned and sum(flags) == 20_000 and len(lines) == 20_001
    deep = "<div>" * 5000 + "text" + "</div>" * 5000
    assert [x[0] for x in html_extraction.page_lines(deep)] == ["text"]
    a = list(range(3000))
    assert html_extraction.shared_lines(a, a[:1000] + a[2000:]) == a[:1000] + a[2000:]
    dotted = word() * 50_000 + " a.b@example.com " + "1" * 50_000 + " " + "1." * 5000
    parts = [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+){3}", dotted)]
    assert pii.base_spans(dotted) == [("email", 250_001, 250_016), *parts] and len(parts) == 1250
    # audio in blocks: the same features however the payload is cut
    payload = bytes(rnd.randrange(256) for _ in range(64 * 3000))
    whole = audio.resample(np.frombuffer(payload, np.uint8), 0, 5000, audio.polyphase_filter())
    parts = [audio.resample(np.frombuffer(payload, np.uint8), k, k + 500, audio.polyphase_filter()) for k in range(0, 5000, 500)]
    assert np.allclose(whole, np.concatenate(parts))


def test_anchors_of_texts_longer_than_a_segment(monkeypatch):
    monkeypatch.setattr(substring_dedup, "SEGMENT", 700)
    rnd = random.Random(21)
    common = bytes(rnd.choice(b"abcd ") for _ in range(1500))
    texts = [bytes(rnd.choice(b"wxyz ") for _ in range(rnd.randint(0, 3000))) + common + bytes(rnd.choice(b"mnop") for _ in range(rnd.randint(0, 900))) for _ in range(6)]
    powers, seen = substring_dedup.Powers(), {}
    for raw in texts:
        at, gram, _, a, b = substring_dedup.anchors_of(np.frombuffer(raw, np.uint8), powers)
        # every string belongs to one piece, and its anchor follows from the string alone
        starts = [s for x, y in zip(a.tolist(), b.tolist(), strict=True) for s in range(x, y - substring_dedup.LENGTH + 1)]
        assert starts == list(range(len(raw) - substring_dedup.LENGTH + 1))
        for place, g, x, y in zip(at.tolist(), gram.tolist(), a.tolist(), b.tolist(), strict=True):
            for s in range(x, y - substring_dedup.LENGTH + 1):
                assert seen.setdefault(raw[s : s + substring_dedup.LENGTH], (g, place - s)) == (g, place - s)


def test_contamination(spark, odd, none):
    rnd = random.Random(10)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    items = [[word() for _ in range(n)] for n in (15, 20, 30, 60, 3)]
    edited = [w if k % 9 else word() for k, w in enumerate(items[2])]
    filler = lambda n: [word() for _ in range(n)]
    rows = [(1, filler(50) + items[0] + filler(50)), (2, filler(90)), (3, filler(9) + edited + filler(9)), (4, filler(5) + items[3][10:40]), (5, [w.upper() + "!!" for w in items[1]]), (6, filler(20) + items[2][:5] + filler(20)), (7, items[4] + filler(4))]
    docs = frame(spark, [(k, " ".join(t), "s") for k, t in rows]).unionByName(odd)
    benchmark = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)] + [(9, None), (10, "")], "item_id long, text string")
    for block in (10**6, 25):
        made = {(r["doc_id"], r["item_id"]): r for r in decontamination.find_contamination(docs, benchmark, block).collect()}
        assert set(made) == {(1, 0), (3, 2), (4, 3), (5, 1), (7, 4)}
        assert made[1, 0]["score"] == 1 and (made[1, 0]["first_word"], made[1, 0]["last_word"]) == (50, 64)
    kept = decontamination.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == 2 + len(ODD)
    assert decontamination.find_contamination(none, benchmark).count() == 0 and decontamination.find_contamination(docs, benchmark.limit(0)).count() == 0


def test_seeds_lose_no_match(spark):
    rnd = random.Random(13)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    common = [word() for _ in range(60)]
    lengths = (1, 3, 7, 8, 9, 15, 16, 38, 41, 59, 90)
    items = [[rnd.choice(common) if rnd.random() < 0.5 else word() for _ in range(n)] for n in lengths]
    rows = []
    for item in items:
        for step in range(2, 12):
            for shift in (0, step // 2):
                for kind in range(3):  # words changed, left out, added
                    edited = [x for k, w in enumerate(item) for x in ([w], [[word()], [], [word(), w]][kind])[k % step == shift]]
                    rows.append([rnd.choice(common) for _ in range(25)] + edited + [rnd.choice(common) for _ in range(25)])
    rows += [[rnd.choice(common)] * 3 + item + [word()] for item in items for _ in range(5)]
    want = {}
    for d, row in enumerate(rows):
        ids = {w: k for k, w in enumerate(dict.fromkeys(row))}
        for k, item in enumerate(items):
            score = decontamination.align(np.array([ids.get(w, -1) for w in item]), np.array([ids[w] for w in row]))[0]
            if score >= min(8, len(item)) and (score >= 0.5 * len(item) or score >= 20):
                want[d, k] = score
    docs = frame(spark, [(d, " ".join(row), "s") for d, row in enumerate(rows)])
    benchmark = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    for block in (10**6, 60):
        found = decontamination.find_contamination(docs, benchmark, block).collect()
        assert {(r["doc_id"], r["item_id"]): r["aligned"] for r in found} == want
    assert decontamination.drop_contaminated(docs, benchmark).count() == len(rows) - len({d for d, _ in want})


def test_alignment():
    def plain(a, b):
        best, h = 0, np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
                best = max(best, h[i, j])
        return best

    rng = np.random.default_rng(11)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 15)), rng.integers(0, 4, rng.integers(1, 25))
        assert decontamination.align(a, b)[0] == plain(a, b)


def test_licenses(spark, odd, none):
    rows = [(1, "text\nLicensed under the Apache License, Version 2.0.", "s"), (2, "He lost his driving license.", "s"), (3, "Licensed under the Foo License, version 2.0", "s"), (4, "This work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License.", "s")]
    made = {r["doc_id"]: r for r in licenses.digests(licenses.scan_licenses(frame(spark, rows))).collect()}
    assert [made[k]["families"] for k in (1, 2, 3, 4)] == ["apache-2.0", "", "", "gpl-3.0,mit"] and made[1]["notices"].startswith("apache-2.0:5:")
    assert licenses.classifier().accuracy > 0.9
    assert {r["n_notices"] for r in licenses.digests(licenses.scan_licenses(odd)).collect()} == {0} and licenses.scan_licenses(none).count() == 0


def test_wrapped_notices_and_openings_without_cues():
    texts = {
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsd",
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:": "bsd",
        "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files": "mit",
        "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.": "gpl-3.0",
    }
    texts |= {
        "Permission to use, copy, modify, and distribute this software for any purpose\nwith or without fee is hereby granted, provided that the above copyright\nnotice and this permission notice appear in all copies.": "isc",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "gpl-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which accompanies this distribution": "epl",
        "This work is licensed under a Creative Commons Attribution License.": "cc-by",
    }
    for text, family in texts.items():
        found = licenses.classifier().notices(f"Other text stands here.\n\n{text}\n\nThe end.")
        assert [n[3] for n in found] == [family] and found[0][:2] == (2, 25) and found[0][2] <= 25 + len(text)
    doubtful = licenses.classifier().notices("Redistributed and used in binary forms, with modification, are the following conditions: permitted source met provided that")
    assert {n[3] for n in doubtful} <= {"unknown", "bsd"}
    for text in ("Er kam mit dem Zug.\nIn the end it was the same.", "Permission was granted.\n\nThe software is free of charge."):
        assert licenses.classifier().notices(text) == []


def test_no_paragraph_that_confirms_is_skipped():
    made, rnd = licenses.classifier(), random.Random(15)
    words = sorted({w for t in made.all_templates for w in t})
    for _ in range(2000):
        own = [w for w in rnd.choice(made.all_templates) if rnd.random() < 0.75] + rnd.sample(words, 2)
        assert made.coverable(set(own)) == any(made.confirm(f, own) >= licenses.CONFIRMED for f in licenses.TEMPLATES)


def test_audio(spark, odd, none):
    rows = audio.audio_features(odd, keep_media=True).collect()
    for r in rows:
        back, rate = audio.from_wav(bytes(r["media"]))
        assert rate == audio.RATE and len(back) % 64 == 0 and len(back) == r["payload_bytes"] >= max(64, r["n_bytes"])
        assert hashlib.sha256(back).hexdigest() == r["payload_sha256"] and zlib.crc32(back[-64:]) == r["tail_crc32"] and len(r["media"]) == r["media_bytes"]
        tensors, start, end = audio.unpack_tensors(bytes(r["tensors"]))
        assert tensors.shape[1:] == (audio.PATCH, audio.MELS) and len(tensors) == len(start) == -(-r["n_frames"] // audio.PATCH) and all(a < b for a, b in zip(start, end))
    texts = {bytes(r["media"])[44 : 44 + r["n_bytes"]].decode() for r in rows}
    assert texts == {t or "" for _, t, _ in ODD}
    assert len({str(r) for r in audio.digests(audio.audio_features(odd)).where("doc_id = 4").collect()}) == 1 and audio.audio_features(none).count() == 0


def test_resampling_and_segments():
    rng = np.random.default_rng(12)
    x, taps = rng.integers(0, 256, 500, dtype=np.uint8), audio.polyphase_filter()
    up = np.zeros(500 * audio.UP)
    up[:: audio.UP] = (x.astype(float) - 128) / 128
    want = np.convolve(up, taps.T.reshape(-1))[: 500 * audio.UP : audio.DOWN]
    n = 500 * audio.UP // audio.DOWN
    assert np.allclose(audio.resample(x, 0, n, taps), want[:n]) and np.allclose(audio.resample(x, 100, 200, taps), want[100:200])
    assert audio.segments(np.array([0, 0, 9, 5, 4, 0, 0, 0, 9.0]) - 0.0) == [(2, 5), (8, 9)]

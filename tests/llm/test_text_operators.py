"""Each operator against a plain version, over nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, text_ string, h long, row_ int, n_lines string"


def table(spark, rows):
    """(doc_id, text, lang, source) rows with columns that clash with helper names."""
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), "x", 1, 2, "y") for i, t, lang, src in rows], DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{'abcdefgh'[rng.randrange(8)]}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    passage, long = words(rng, 60), words(rng, 3000)
    base = [words(rng, 150, 10**6) for _ in range(6)]
    rows = [(i, b, "en", f"s{i % 4}") for i, b in enumerate(base)]
    rows += [(10 + i, b.replace(b.split()[7], "changed"), "en", f"s{i % 4}") for i, b in enumerate(base[:4])]
    rows += [(20 + i, base[0], "en", "s9") for i in range(3)]
    rows += [(30, "lead " + passage + " tail", None, None), (31, words(rng, 20) + passage, "en", "s1"), (32, long, "en", "s2"), (33, long[500:], "en", "s2")]
    rows += [(40, None, None, None), (41, "", "en", "s1"), (42, "one", "en", "s1"), (43, "ONE", "en", "s2"), (44, "a b c d", "en", "s3"), (45, "A  b\tC d", "en", "s3"), (46, "z" * 400, "en", "s1"), (47, "éà" * 300, "fr", "s1")]
    return rows


# 1


def removed(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p] += 1
                gone[p + length] -= 1
            seen.add(b[p : p + length])
        m = np.cumsum(gone[:-1]) > 0
        kept = bytes(x for x, g in zip(b, m, strict=True) if not g)
        out[i] = (len(b), int(m.sum()), int((np.diff(np.concatenate(([0], m.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, corpus):
    from affinigraph.llm.suffix_dedup import remove_repeats

    got = {r.doc_id: tuple(r)[1:] for r in remove_repeats(table(spark, corpus)).collect()}
    assert got == removed([r[:2] for r in corpus], 100)


def test_suffix_dedup_defined_cases(spark):
    from affinigraph.llm.suffix_dedup import remove_repeats

    assert remove_repeats(table(spark, [])).count() == 0
    rows = [(None, "q" * 200, "en", "s"), (1, "b" * 10, "en", "s"), (1, "a" * 150, "en", "s"), (1, "a" * 150, "en", "s")]
    (r,) = remove_repeats(table(spark, rows), keep_bytes=True).collect()
    assert (r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept), r.spans) == (1, 150, 149, b"a", [[1, 150]])


@pytest.mark.parametrize("hot", [2, 4096])
def test_suffix_dedup_of_a_common_passage(spark, hot):
    """One passage in many texts whose surroundings differ, so that its q-grams meet everywhere; hot ones go by windows."""
    from affinigraph.llm.suffix_dedup import remove_repeats

    rng = random.Random(8)
    passage = words(rng, 40)
    rows = [(i, words(rng, rng.randrange(1, 30), 10**6) + passage + words(rng, rng.randrange(1, 30), 10**6), "en", "s") for i in range(60)]
    rows += [(100 + i, passage * 3 + "x" * i, "en", "s") for i in range(4)]
    got = {r.doc_id: tuple(r)[1:] for r in remove_repeats(table(spark, rows), hot=hot, range_bytes=4096).collect()}
    assert got == removed([r[:2] for r in rows], 100)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=0, max_size=6), max_size=12).map(sorted), min_size=1, max_size=7))
def test_loser_tree(runs):
    from affinigraph.llm.suffix_dedup import _first_difference, merge_runs

    shared = [[0, *(_first_difference(a, b, 0) for a, b in zip(r, r[1:], strict=False))][: len(r)] for r in runs]
    got = list(merge_runs(list(zip(runs, shared, strict=True))))
    keys = [runs[r][i] for r, i, _ in got]
    assert keys == sorted(k for r in runs for k in r)
    assert [s for _, _, s in got][1:] == [_first_difference(a, b, 0) for a, b in zip(keys, keys[1:], strict=False)]


# 2 and 6


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    from affinigraph.llm.packing import pack

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [*corpus, (50, "It's 12 o'clock — ΣΑΣ İ é x <|endoftext|> 中文 ½ don't\x1cstop", "en", "s"), (50, "again", "en", "s"), (None, "none", "en", "s")]
    got = [r.asDict() for r in pack(table(spark, rows), path, window=64, keep_ids=True).collect()]
    t = Tokenizer.from_file(path)
    want = sorted(([i if i is not None else -1, [*t.encode(x or "", add_special_tokens=False).ids, 2]] for i, x, *_ in rows))
    by_seq = {}
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for k, v in by_seq.items():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at == 64 or k == max(by_seq)
    assert sorted(by_seq) == list(range(len(by_seq)))
    assert sum(r["length"] for r in got) == sum(len(x) for _, x in want)
    unique = {i: x for i, x in want if i not in (50, -1)}
    for i, ids in unique.items():
        own = sorted((r["start"], r["ids"]) for r in got if r["doc_id"] == i)
        assert np.frombuffer(b"".join(p for _, p in own), "<u4").tolist() == ids
    assert pack(table(spark, []), path).count() == 0


def test_token_counts(spark, corpus):
    import tiktoken

    from affinigraph.llm.token_counts import section_counts
    from affinigraph.llm.tokenizing import byte_tokenizer

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = [*corpus, (60, "a title\n\n  body of text\nmore é\n", "en", "s")]
    enc: tiktoken.Encoding = byte_tokenizer(path, public_tokenizers.PATTERN).encoding
    for rule in ("most", "first"):
        got = {}
        for r in section_counts(table(spark, rows), path, public_tokenizers.PATTERN, rule=rule).collect():
            got.setdefault(r.doc_id, []).append(r)
        for i, t, *_ in rows:
            b, at, want = (t or "").encode(), 0, {}
            lines = b.split(b"\n")
            pieces = [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
            starts = np.cumsum([0, *map(len, pieces)])
            for tok in enc.encode_ordinary(t or ""):
                n = len(enc.decode_single_token_bytes(tok))
                shares = [max(0, min(at + n, starts[k + 1]) - max(at, starts[k])) for k in range(len(pieces))]
                own = shares.index(max(shares)) if rule == "most" else next(k for k, x in enumerate(shares) if x)
                want[own] = want.get(own, 0) + 1
                at += n
            assert [r.n_tokens for r in sorted(got[i], key=lambda r: r.section)] == [want.get(k, 0) for k in range(len(pieces))]
    with pytest.raises(ValueError):
        section_counts(table(spark, rows), path, public_tokenizers.PATTERN, rule="other")
    assert section_counts(table(spark, []), path, public_tokenizers.PATTERN).count() == 0
    again = section_counts(table(spark, [corpus[0]] * 3), path, public_tokenizers.PATTERN).collect()
    assert len(again) == 3 and len(set(again)) == 1


def test_token_counts_of_fields(spark):
    from affinigraph.llm.token_counts import field_counts
    from affinigraph.llm.tokenizing import byte_tokenizer

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = byte_tokenizer(path, public_tokenizers.PATTERN).encoding
    rows = [(1, "A title", "a body of some words", "x"), (2, None, "only a body", None), (None, "", "", ""), (1, "A title", "a body of some words", "x"), (3, "éé", "  \n", "end")]
    docs = spark.createDataFrame(rows, "doc_id long, title string, text string, tail string")
    got = field_counts(docs, ["title", "text", "tail"], path, public_tokenizers.PATTERN).collect()
    assert len(got) == 15
    for i, *values in rows:
        whole = "\n".join(v or "" for v in values)
        own = [r for r in got if r.doc_id == i]
        copies = sum(r[0] == i for r in rows)
        assert sum(r.n_tokens for r in own) == copies * len(enc.encode_ordinary(whole))
        ends = {r.field: (r.start_byte, r.end_byte) for r in own}
        assert ends["title"][0] == 0 and ends["tail"][1] == len(whole.encode()) and ends["title"][1] == ends["text"][0]
    assert {r.field: r.n_tokens for r in got if r.doc_id == 2}["tail"] == 0
    assert field_counts(docs.limit(0), ["title"], path, public_tokenizers.PATTERN).count() == 0


# 4


def test_line_dedup(spark):
    from affinigraph.llm.lines import remove_boilerplate

    rows = [(i, f"own {i}\n  common line \nend {i}", "en", f"s{i % 5}") for i in range(12)]
    rows += [(20, "common line", "en", "s0"), (21, None, "en", "s0"), (22, "", None, None), (23, "twice\ntwice\n\n", "en", "s1"), (None, "common line\nx", "en", None)]
    rows += [(30 + i, "few sites", "en", f"s{i % 2}") for i in range(9)]
    out = remove_boilerplate(table(spark, rows), min_sites=4)
    assert out.columns == table(spark, []).columns + ["n_removed"]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in out.collect()}
    assert got[0] == (3, 0, "own 0\n  common line \nend 0")
    assert all(got[i] == (3, 1, f"own {i}\nend {i}") for i in range(1, 12))
    assert got[20] == (1, 1, "") and got[21] == (0, 0, None) and got[22] == (1, 0, "") and got[23] == (4, 0, "twice\ntwice\n\n")
    assert got[None] == (2, 1, "x") and got[33] == (1, 0, "few sites")
    assert remove_boilerplate(table(spark, [])).count() == 0
    long = "common line\n" + "one long line " * 200_000
    twice = table(spark, rows[:12] + [(40, long, "en", "s1"), (40, long, "en", "s1"), (40, "another text", "en", "s1")])
    got = sorted(r.text for r in remove_boilerplate(twice, min_sites=4).where("doc_id = 40").collect())
    assert got == ["another text", "one long line " * 200_000, "one long line " * 200_000]


# 5


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("options", [{}, {"short": 4, "block": 8, "k": 32, "leaders": 2}, {"exact": True, "k": 2, "short": 4, "block": 8, "leaders": 1}])
def test_near_duplicates(spark, corpus, options):
    from affinigraph.llm.near_duplicates import drop_near_duplicates, near_duplicates

    rng = random.Random(8)
    shared = words(rng, 40, 10**6).split()
    rows = [r[:2] for r in corpus]
    for i in range(60):  # near copies of one text, and texts that share a passage
        w = list(shared) + [f"base{k}" for k in range(60)]
        for _ in range(rng.randrange(4)):
            w[rng.randrange(40, 100)] = f"edit{rng.random()}"
        rows.append((100 + i, " ".join(w)))
        rows.append((200 + i, " ".join([*shared, *words(rng, 60, 10**6).split()])))
    for i in range(12):  # a chain of neighbouring edits
        rows.append((300 + i, " ".join(f"c{k}" for k in range(i * 4, i * 4 + 80))))
    rng.shuffle(rows)
    docs = table(spark, [(i, t, None, None) for i, t in rows])
    got = {r.doc_id: tuple(r)[1:] for r in near_duplicates(docs, **options).collect()}
    want = components(rows)
    assert got == want
    if not options:
        kept = drop_near_duplicates(docs.unionByName(table(spark, [(None, "x", None, None)])))
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(i for i, x in want.items() if x[2])
        assert kept.where("doc_id is null").count() == 1
        assert near_duplicates(table(spark, [])).count() == 0


def test_near_duplicates_with_shared_ids(spark):
    """Of rows with one id that with the fewest shingles counts; but rows are dropped each for its own text."""
    from affinigraph.llm.near_duplicates import drop_near_duplicates, near_duplicates

    rng = random.Random(4)
    a, b, c = (words(rng, n, 10**6) for n in (40, 50, 60))
    rows = [(1, a), (2, a), (2, b), (3, b), (3, b), (None, c), (None, c), (4, c), (5, None), (5, ""), (5, None)]
    docs = table(spark, [(i, t, "en", "s") for i, t in rows])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == {1: (36, 1), 2: (36, 1), 3: (46, 3), 4: (56, 4), 5: (0, 5)}
    kept = sorted(((r.doc_id, r.text) for r in drop_near_duplicates(docs).collect()), key=str)
    assert kept == sorted([(1, a), (2, b), (4, c), (5, None), (5, ""), (5, None)], key=str)


def test_joins_of_large_tables_are_salted(spark):
    from pyspark.sql import functions as F

    from affinigraph.llm._common import joined_by

    rows = spark.range(300).select("id", F.when(F.col("id") < 200, 7).otherwise(F.col("id") % 5).alias("k"))
    keys = spark.createDataFrame([(7, "hot"), (1, "one"), (9, "none")], "k long, name string")
    want = sorted(map(tuple, rows.join(keys, "k").select("id", "name").collect()))
    for small in (True, False):
        assert sorted(map(tuple, joined_by(rows, keys, ["k"], F.col("id"), small=small).select("id", "name").collect())) == want
        assert joined_by(rows, keys, ["k"], F.col("id"), "left", small=small).count() == 300
        assert joined_by(rows, keys, ["k"], F.col("id"), "left_semi", small=small).count() == len(want)


# 8


def test_privacy_base(spark):
    from affinigraph.llm.privacy import joined, sanitise

    texts = [
        "mail a.b@c.de and x@y. no a@b z@q-1.co.uk_x@y.zz",
        "ip 1.2.3.4 300.1.1.1 1.2.3.4.5.6.7.8 007.0.0.001 1.2.3",
        "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 5500000000000004 12  34 5",
        "tel +1 (650) 555-0100 +49.30.1234567 +1-2 + 3 +1234567890123456 ++44 20 7946 0958",
        "é😀 +33 1 23 45 67 89 ünï@x.fr 10.0.0.255", None, "", "nothing here", "9" * 5000 + " " + "1 " * 3000 + "a" * 20000 + "@" + "1." * 3000,
    ]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, "a@b.c", "en", "s"), (1, texts[0], "en", "s")]
    out = sanitise(table(spark, rows)).select("doc_id", "text", joined("base").alias("b"), joined("spans").alias("s"), "clean_text").collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.b == ",".join(base_spans(r.text or "")) == r.s
    assert next(r.clean_text for r in out if r.doc_id is None) == "[EMAIL]"
    assert sanitise(table(spark, [])).count() == 0


def base_spans(t):
    found = []
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for k, p in kinds.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            total = sum(int(c) if n % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for n, c in enumerate(reversed(d)))
            if k == "email" or (k == "ip" and all(int(x) < 256 for x in m[0].split("."))) or (k == "card" and 16 <= len(d) <= 19 and total % 10 == 0) or (k == "phone" and 8 <= len(d) <= 15):
                found.append(f"{k}:{m.start()}:{m.end()}")
    return found


def test_privacy_discloses(spark):
    from affinigraph.llm.privacy import sanitise

    rows = [(i, f"the zorblatt on floor {i} answers as chief@corp.example today\nweather is fine {i}", "en", "s") for i in range(5)]
    rows += [(10 + i, f"the office is open today number {i}\nno mail", "en", "s") for i in range(40)]
    got = {r.doc_id: r for r in sanitise(table(spark, rows)).collect()}
    for i in range(5):
        terms = {s.value for s in got[i].spans if s.kind == "term"}
        assert "zorblatt" in terms and not terms & {"the", "today", "is"}
        assert "zorblatt" not in got[i].clean_text and "[EMAIL]" in got[i].clean_text
    assert all(got[10 + i].clean_text == got[10 + i].text for i in range(40))
    gone = {r.doc_id: r.clean_text for r in sanitise(table(spark, rows), action="remove").collect()}
    assert "[" not in gone[0] and "chief@corp" not in gone[0]


def test_privacy_discloses_entities_seen_once(spark):
    from affinigraph.llm.privacy import sanitise

    rows = [(0, "the quixwort of the office answers as lone@corp.example today", "en", "s")]
    rows += [(10 + i, f"the office of floor {i} answers today", "en", "s") for i in range(60)]
    got = {r.doc_id: r for r in sanitise(table(spark, rows)).collect()}
    assert {s.value for s in got[0].spans if s.kind == "term"} >= {"quixwort"}
    assert not {s.value for s in got[0].spans} & {"the", "office", "of", "answers", "today"}
    assert all(got[10 + i].clean_text == got[10 + i].text for i in range(60))


def told(rows, disclosure=0.8, support=3):
    """{text: [(kind, start, end)]} with emails as the only entities, from counts over the distinct lines."""
    email, word = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), re.compile(r"[^\s!-/:-@\[-`{-~]+", re.ASCII)
    lines = {x for t in rows if t is not None for x in t.split("\n")}
    of = {x: ({m.lower() for m in email.findall(x)}, {w.lower() for w in word.findall(x)}) for x in lines}
    entities = {e for es, _ in of.values() for e in es}
    n_term = {}
    for _, ws in of.values():
        for w in ws:
            n_term[w] = n_term.get(w, 0) + 1
    telling = set()
    for e in entities:
        own = [ws for es, ws in of.values() if e in es]
        for w in set().union(*own):
            both = sum(w in ws for ws in own)
            both -= 0.5 * (both < support)
            n = max(len(lines), n_term[w], len(own))
            if w not in e and re.search(r"[^\W\d_]", w) and np.log(both * n / (len(own) * n_term[w])) >= disclosure * np.log(n / len(own)):
                telling.add((e, w))
    out = {}
    for t in rows:
        base = [("email", *m.span()) for m in email.finditer(t or "")]
        mine = {m.group().lower() for m in email.finditer(t or "")}
        extra = [("term", *m.span()) for m in word.finditer(t or "") if any((e, m.group().lower()) in telling for e in mine)]
        out[t] = base + [x for x in extra if not any(b < x[2] and x[1] < c for _, b, c in base)]
    return out, telling


def test_privacy_terms_against_plain_counts(spark):
    from affinigraph.llm.privacy import sanitise

    rng = random.Random(21)
    people = [f"p{k}@mail{k % 3}.org" for k in range(9)]
    rows = []
    for i in range(120):
        text = [words(rng, rng.randrange(1, 9), 12) for _ in range(rng.randrange(1, 5))]
        if rng.random() < 0.6:
            k = rng.randrange(9)
            text[0] += f" Émile{k} called {people[k].upper() if rng.random() < 0.3 else people[k]}, {rng.choice(['clerk', 'baker'])} nick{rng.randrange(4)}"
        rows.append("\n".join(text))
    rows += [rows[0]] * 3 + [None, "", "Émile1 alone", ("filler " * 9 + "\n") * 3000 + rows[1]]
    want, telling = told(rows)
    got = sanitise(table(spark, [(i, t, "en", "s") for i, t in enumerate(rows)])).collect()
    assert len(got) == len(rows) and len(telling) >= 9
    for r in got:
        assert [(s.kind, s.start, s.end) for s in r.spans] == want[r.text], r.doc_id
    assert any(k == "term" for spans in want.values() for k, *_ in spans)


def test_privacy_of_entities_on_one_line(spark):
    from affinigraph.llm.privacy import joined, sanitise

    rng = random.Random(8)
    group = ["a.bo@mail1.org", "bo@mail1.org", "cy@mail2.net"]
    rows = [f"staff {' '.join(group)} of bo and cy at mail1 quixwort, org {k} {words(rng, 4, 12)}" for k in range(4)]
    rows += [f"{words(rng, 5, 12)} di@x.de with {rng.choice(group) if k % 2 else 'nobody'} bo zzyzx{k % 3}" for k in range(6)]
    rows += [words(rng, 8, 12) + f" {k}" for k in range(150)] + [rows[0] + "\n" + rows[5], "mail1 alone", "é😀 bo@mail1.org"]
    want, telling = told(rows)
    got = sanitise(table(spark, [(i, t, "en", "s") for i, t in enumerate(rows)])).collect()
    for r in got:
        assert [(s.kind, s.start, s.end) for s in r.spans] == want[r.text], r.doc_id
        plain, at = [], 0
        for kind, a, b in sorted(want[r.text], key=lambda x: x[1]):
            plain += [r.text[at:a], f"[{kind.upper()}]"]
            at = b
        assert r.clean_text == "".join(plain) + r.text[at:]
    assert len(telling) > 20

    # one text with 50,000 addresses in lines of 1,000, each line with as many other words; some 40 s on four threads
    many = "\n".join(" ".join(f"é word{a}x{k} u{a}.{k}@h{k % 7}.org" for k in range(1000)) for a in range(50))
    (r,) = sanitise(table(spark, [(1, many, "en", "s")])).select(joined("base").alias("b"), "clean_text").collect()
    assert r.b == ",".join(base_spans(many)) and r.clean_text.count("[EMAIL]") == 50_000 and "@" not in r.clean_text


# 9


def test_decontamination(spark):
    from affinigraph.llm.decontaminate import drop_leaks, find_leaks

    rng = random.Random(3)
    items = [words(rng, n, 10**6) for n in (20, 45, 9, 4)]
    bench = spark.createDataFrame([*enumerate(items), (7, None), (None, "x"), (8, ""), (9, items[1])], "item_id long, text string")

    def edited(t, n):
        t = list(t)
        for _ in range(n):
            k = rng.randrange(3, len(t) - 3)
            t[k : k + 1] = rng.choice([[], ["#"], [t[k], "#"]])
        return "".join(t)

    clean = [words(rng, 300, 10**6) for _ in range(20)]
    rows = [(i, c, "en", "s") for i, c in enumerate(clean)]
    rows += [(100 + k, clean[0][:200] + " " + t + " " + clean[1][:200], "en", "s") for k, t in enumerate(items)]
    rows += [(110 + k, clean[2][:100] + edited(t, max(1, len(t) // 30)) + clean[3][:100], "en", "s") for k, t in enumerate(items[:3])]
    rows += [(120, items[1].upper().replace(" ", "\n"), "en", "s"), (121, items[1][:130], "en", "s"), (122, None, "en", "s"), (123, "", "en", "s"), (None, items[0], "en", "s")]
    docs = table(spark, rows)
    for size in (1 << 20, 64):  # one block of items, and several
        got = find_leaks(docs, bench, block_bytes=size).collect()
        pairs = {(r.doc_id, r.item_id) for r in got}
        assert pairs == {(100, 0), (101, 1), (101, 9), (102, 2), (103, 3), (110, 0), (111, 1), (111, 9), (112, 2), (120, 1), (120, 9), (121, 1), (121, 9), (None, 0)}
    exact = {(r.doc_id, r.item_id): r for r in got}
    r = exact[100, 0]
    t = dict((x[0], x[1]) for x in rows)[100]
    assert r.edits == 0 and t.encode()[r.start_byte : r.end_byte].decode() in items[0]
    kept = drop_leaks(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {*range(20), 122, 123}
    assert {r.doc_id for r in drop_leaks(docs, bench, block_bytes=64).collect()} == {*range(20), 122, 123}
    twice = table(spark, [rows[0], rows[0], (0, items[0], "en", "s"), (5, ("x" * 70 + " ") * 60_000 + items[1] + " y" * 60_000, "en", "s")] + rows[100:101] * 2)
    assert sorted((r.doc_id, r.item_id) for r in find_leaks(twice, bench).collect()) == [(0, 0), (5, 1), (5, 9)]
    assert [r.text for r in drop_leaks(twice, bench).collect()] == [clean[0]] * 2  # by the row's own text, not by its id
    assert find_leaks(table(spark, []), bench).count() == 0 and find_leaks(docs, bench.limit(0)).count() == 0


def test_decontamination_finds_parts_at_any_offset(spark):
    from affinigraph.llm.decontaminate import find_leaks

    rng = random.Random(8)
    items = [words(rng, 60, 10**6) for _ in range(4)]
    frame = [words(rng, 40, 10**6) for _ in range(2)]
    rows, want = [], set()
    for n in (64, 75, 90, 119, 140):
        for at in (0, 1, 17, 31, 45, 59, 77):
            for k in (0, 1):
                part = items[k][at : at + n]
                if n > 100 and at % 2:  # edits in 8 % of the bytes at most
                    part = part[:20] + "#" + part[21:60] + part[61:]
                want.add((len(rows), k))
                rows.append((len(rows), frame[0] + part + frame[1], "en", "s"))
    short = [(1000 + at, frame[0] + items[2][at : at + 40] + frame[1], "en", "s") for at in (0, 30)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = find_leaks(table(spark, rows + short), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    text = {r[0]: r[1] for r in rows}
    for r in got:
        if r.edits == 0:
            assert text[r.doc_id].encode()[r.start_byte : r.end_byte].decode().lower() in items[r.item_id].lower()


def least_edits(own, text):
    """Edits of each row of ``own`` against its best place in a text: the whole table of the alignment, no bands."""
    cost = np.zeros((len(own), len(text) + 1), int)
    at = np.arange(len(text) + 1)
    for i in range(own.shape[1]):
        new = np.concatenate([np.full((len(own), 1), i + 1), np.minimum(cost[:, :-1] + (text != own[:, i : i + 1]), cost[:, 1:] + 1)], axis=1)
        cost = np.minimum.accumulate(new - at, axis=1) + at
    return cost.min(axis=1)


def test_decontamination_against_whole_alignment():
    from affinigraph.llm.decontaminate import QGramIndex, fold

    rng = random.Random(12)
    items = [words(rng, n, 60).encode() for n in (14, 25, 40, 60)] + [b"seven w", b"eight wo"]
    index = QGramIndex(list(enumerate(items)))
    texts = []
    for _ in range(70):
        own = items[rng.randrange(4)]
        a = rng.randrange(max(1, len(own) - 50))
        part = bytearray(own[a : a + rng.randrange(40, 200)])
        for _ in range(rng.randrange(12)):
            k = rng.randrange(len(part))
            part[k : k + 1] = rng.choice([b"", b"#", bytes([part[k]]) + b"#"])
        texts.append(words(rng, 8, 60).encode() + part + words(rng, 8, 60).encode())
    texts += [b"", b"eight wo", b"seven w"]
    offsets = np.cumsum([0, *map(len, texts)])
    got = {(d, k) for d, k, *_ in index.leaks(np.frombuffer(b"".join(texts), np.uint8), offsets)}
    want = set()
    for d, t in enumerate(texts):
        t = fold(np.frombuffer(t, np.uint8)) if t else np.zeros(0, np.uint8)
        for k, raw in enumerate(items):
            x = fold(np.frombuffer(raw, np.uint8))
            starts = [0] if len(x) <= 120 else [*range(0, len(x) - 120, 60), len(x) - 120]
            pieces = np.stack([x[s : s + 120] for s in starts])
            budget = min(int(0.08 * pieces.shape[1]), pieces.shape[1] // 8 - 1)
            windows = np.lib.stride_tricks.sliding_window_view(x, 64) if len(x) > 64 else np.zeros((0, 64), np.uint8)
            if (least_edits(pieces, t) <= budget).any() or len(windows) and (least_edits(windows, t) <= 5).any():
                want.add((d, k))
    assert got == want and 20 < len(want) < 70 + 2


# 10


def test_language_against_plain_forward_pass():
    from affinigraph.llm.language import ByteConvNet

    net = ByteConvNet(["a", "b", "c"], window=32)
    net.bias += np.linspace(-0.5, 0.5, len(net.bias)).astype(np.float32)
    texts = ["short", "é" * 40, "the quick brown fox jumps over the lazy dog " * 3]
    raw = [t.encode() for t in texts]
    got = net.predict_texts(np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8))
    for own, p in zip(raw, got, strict=True):
        total = [0.0] * 3
        for at in range(0, len(own), 32):
            part = own[at : at + 32]
            padded, pooled = part.ljust(32, b"\0"), []
            for f in range(len(net.bias)):
                width = net.widths[f // net.filters]
                best = max(sum(float(net.emb[padded[i + k]][j]) * float(net.kernel[k * net.dim + j, f]) for k in range(width) for j in range(net.dim)) for i in range(32 - max(net.widths) + 1))
                pooled.append(max(0.0, best + float(net.bias[f])))
            z = [sum(x * float(w) for x, w in zip(pooled, net.out[:, c], strict=True)) + float(net.out_bias[c]) for c in range(3)]
            e = [np.exp(x - max(z)) for x in z]
            total = [t + len(part) * x / sum(e) for t, x in zip(total, e, strict=True)]
        np.testing.assert_allclose(p, [t / len(own) for t in total], atol=1e-4)


def test_language(spark):
    from affinigraph.llm.language import held_out, identify, train
    from pyspark.sql import functions as F

    rng = random.Random(1)
    sounds = {"aa": ["ka", "lu", "mo", "ti"], "bb": ["sch", "ver", "ung", "ich"], "cc": ["éa", "ñu", "ción", "qué"]}
    rows = [(i, " ".join("".join(rng.choices(sounds[lang], k=3)) for _ in range(rng.randrange(5, 200))), lang, "s") for i in range(300) for lang in [rng.choice(list(sounds))]]
    docs = table(spark, rows)
    model = train(docs)
    got = identify(docs.withColumn("held", held_out(F.col("doc_id"))), model, keep=("doc_id", "held", "text_")).collect()
    held = [r for r in got if r.held]
    truth = {r[0]: r[2] for r in rows}
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    odd = table(spark, [(1, None, None, None), (2, "", None, None), (3, "12 !?", None, None), (None, "kalumo " * 100_000, None, None)])
    out = {r.doc_id: (r.lang_pred, r.score) for r in identify(odd, model, keep=("doc_id",)).collect()}
    assert out[1] == out[2] == out[3] == ("und", 0.0) and out[None][0] == "aa" and 0 <= out[None][1] <= 1
    assert train(table(spark, [])) is None and identify(odd, None, keep=("doc_id",)).where("lang_pred <> 'und'").count() == 0
    assert identify(table(spark, []), model, keep=("doc_id",)).count() == 0
    again = [tuple(r) for r in identify(table(spark, rows[:1] * 3), model, keep=("doc_id",)).collect()]
    assert len(again) == 3 and len(set(again)) == 1

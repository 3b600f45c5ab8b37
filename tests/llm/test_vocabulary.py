"""Spelling variants, the source audit and token files, against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict
from glob import glob

import numpy as np
import public_tokenizers
import pyarrow.orc as orc
import pytest
from tokenizers import Tokenizer

from tradewind.llm import source_audit, spelling, token_orc, transducer
from tradewind.llm.fm_index import Index
from tradewind.session import fresh_path

MODEL = public_tokenizers.path("word_bpe_49k.json")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("seed", range(4))
def test_index_finds_all_pairs_one_edit_apart(seed):
    draw = random.Random(seed)
    words = {"".join(draw.choice("abé" if seed else "aÿ") for _ in range(draw.randint(2, 8))) for _ in range(250)} | {"x" * 70, "x" * 71, "q"}
    index = Index(list(words))
    everyone = np.arange(len(index.words))
    got = {(index.words[i], index.words[j]) for side in (True, False) for i, j in zip(*index.near(everyone, side))}
    assert got == {(a, b) for a in words for b in words if len(a) <= len(b) and one_edit(a, b)}


def plain_variants(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    out, form = {}, {}
    for w in n:
        near = [x for x in n if x != w and abs(len(x) - len(w)) < 2 and one_edit(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
        out[w] = (n[w], len(near), n[best] if form[w] else None)
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, *out[w])
    return {(w, *v) for w, v in out.items()}


@pytest.mark.parametrize("limits", [{}, {"slot_rows": 20, "hot_rows": 8}])
def test_variants_equal_plain_version(spark, awkward, limits):
    chain = "wonderful " * 400 + "wonderfull " * 30 + "wonderfulll " * 2 + "Wonderfux wonderfux " + "wondErful ÀÉÎÕÜßÿ ÀÉÎÕÜßÿ " + "aaaaaaaa " * 25 + "aaaaaaa " * 2 + "k" * 5000 + " " + "k" * 5000 + " " + "k" * 5001 + " " + "k" * 5001
    rows = [(i, chain) for i in range(1, 8)] + [(None, chain), (None, None), (9, "")]
    docs = awkward.select("doc_id", "text", "n", "key").union(spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, key string"))
    got = spelling.group_variants(docs, **limits)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_variants([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert any(r[1] and r[2] != r[1] for r in want) and any(r[0] == "k" * 5001 for r in want)


def test_variants_of_nothing(spark, nothing):
    assert spelling.group_variants(nothing).count() == 0
    assert spelling.group_variants(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("terms", [[], [b"a"], [b"a", b"ab", b"abc", b"b"], sorted({bytes(random.Random(s).choices(b"abc\xc3\xa9", k=1 + s % 7)) for s in range(400)})])
def test_transducer_maps_terms_to_ordinals(terms):
    machine = transducer.Transducer(transducer.build(terms))
    assert machine.terms == len(terms)
    asked = [*terms, b"z", b"abcabcabc", b"ab\xff"]
    code = np.frombuffer(b" ".join(asked) + b" ", dtype=np.uint8)
    end = np.cumsum([len(t) + 1 for t in asked]) - 1
    start = end - [len(t) for t in asked]
    place = {t: i for i, t in enumerate(terms)}
    assert machine.walk(code, start, end).tolist() == [place.get(t, -1) for t in asked]


def test_transducer_is_minimal_and_wants_order():
    # Two stems with the same three endings share all states after the first letter.
    terms = sorted(a + b for a in (b"x", b"y", b"z") for b in (b"ed", b"ing", b"s"))
    assert transducer.Transducer(transducer.build(terms)).states == 2 + 1 + 1 + 2
    for wrong in ([b"b", b"a"], [b"a", b"a"]):
        with pytest.raises(ValueError):
            transducer.build(wrong)


def plain_audit(rows, least):
    docs = defaultdict(lambda: defaultdict(set))
    counts = defaultdict(Counter)
    for k, (text, lang, source) in enumerate(rows):
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts[lang or "", source or ""].update(terms)
        for t in terms:
            docs[lang or ""][t].add(k)
    out = set()
    for lang in {g[0] for g in counts}:
        kept = sorted((t for t, d in docs[lang].items() if len(d) >= least), key=str.encode)
        sources = sorted((s for l, s in counts if l == lang), key=str.encode)
        every = sum((counts[lang, s] for s in sources), Counter())
        share = lambda c: [1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept]
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: share(counts[lang, s]) for s in sources}, share(every)
        for s in sources:
            pairs = sorted(((-sum(map(f, p[s], p[o])), o) for o in sources if o != s), key=lambda x: (x[0], x[1].encode()))
            terms = sorted((-f(a, b), t) for a, b, t in zip(p[s], q, kept) if counts[lang, s][t] and a > b)
            terms = sorted(terms, key=lambda x: (x[0], x[1].encode()))[:10]
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, o) in enumerate(pairs)} | {(lang, s, "term", t, -v, i + 1) for i, (v, t) in enumerate(terms)}
    return out


@pytest.mark.parametrize("least, limits", [(2, {}), (1, {"shard_terms": 400, "wave_bytes": 12_000, "tile_sources": 2}), (99, {})])
def test_audit_equals_plain_version(spark, awkward, documents, monkeypatch, least, limits):
    docs = awkward.select("text", "lang", "source", "key", "n").union(documents.limit(25).selectExpr("text", "lang", "source", "'k'", "1L"))
    docs = docs.union(spark.createDataFrame([("Ab Ab cD ÄÖ 　x中 中", None, "\U0001f600", "k", 1), ("ab\x7fcd 12", None, "￮", "k", 1), ("!!", "zz", "only", "k", 1)], docs.schema))
    got = [tuple(r) for r in source_audit.audit(docs, min_documents=least, **limits).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit([(r["text"], r["lang"], r["source"]) for r in docs.collect()], least)


def test_audit_of_nothing_and_wide_counts(nothing):
    assert source_audit.audit(nothing).count() == 0
    n, total = np.array([5, 10**13, 9 * 10**13]), np.array([7, 10**14 - 1, 9 * 10**13 + 8])
    assert source_audit._share(n, total).tolist() == [1 + 10**9 * int(a) // int(b) for a, b in zip(n, total)]


def encoded(texts):
    library = Tokenizer.from_file(MODEL)
    library.encode_special_tokens = True
    return [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def test_words_equal_library():
    known = token_orc.PieceIds(open(MODEL).read())
    known.check()
    library = Tokenizer.from_file(MODEL)
    library.encode_special_tokens = True
    draw, letters = random.Random(5), ["a", "B", "é", "À", "ß", "ÿ", "×", "÷", "¿", "ſ", "e\u0301", "\u0301", "H\u0331", " ", "\t", "\x0b", "\x1c", "\x85", "\xa0", "'s", "'", "'LL", "'re", "1", "½", "中", "İ", "Σ", "<|endoftext|>", "!", "\x01", "\x00", "-", "_"]
    for _ in range(20000):
        text = "".join(draw.choices(letters, k=draw.randint(0, 12)))
        words = known.split(text.encode())
        known.learn(set(words))
        assert np.frombuffer(b"".join(known[w] for w in words), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_files_equal_library(spark, awkward, documents):
    odd = ["<|endoftext|> don't IT'LL", "\x01 a\x01b \x01", "ȩ́ ́x", "\x1c\x85\xa0  x　y", "日本語 ½ ١٢٣", "İΣ ß ﬁ", "w" * 3000, "a\tb\vc\fd\re\nf"]
    docs = awkward.select("doc_id", "text", "n", "key").union(documents.limit(40).selectExpr("doc_id + 1000", "text", "1L", "'k'"))
    docs = docs.union(spark.createDataFrame([(500 - i, t, 1, "k") for i, t in enumerate(odd)], docs.schema))
    folder = fresh_path(spark, "token-orc-test")
    token_orc.write(docs.repartition(3), folder, MODEL)
    got = sorted(map(tuple, token_orc.digests(token_orc.read(spark, folder)).collect()), key=lambda r: r[1])
    rows = docs.collect()
    ids = encoded([r["text"] for r in rows])
    want = Counter((r["doc_id"], len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for r, x in zip(rows, ids))
    assert Counter((d, n, c) for d, _, n, c in got) == want
    order = [-1 if d is None else d for d, *_ in got]
    assert order == sorted(order)
    assert [s for _, s, _, _ in got] == [0, *np.cumsum([n for _, _, n, _ in got])[:-1].tolist()]


def test_token_files_have_stripes_indexes_and_filters(spark, tmp_path):
    docs = spark.range(0, 40000, 1, 2).selectExpr("id * 3 as doc_id", "repeat(concat('token ', id, ' '), 20) as text")
    folder = f"{tmp_path}/orc"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_orc.write(docs, folder, MODEL, stripe_mb=0, index_rows=1000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(glob(f"{folder}/*.orc"))
    assert len(files) > 1 and sum(orc.ORCFile(f).nstripes for f in files) > len(files)
    least = [orc.read_table(f, columns=["doc_id"])["doc_id"].to_numpy() for f in files]
    assert (np.diff(np.concatenate(least)) == 3).all()
    jvm = spark._jvm
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(files[0]), jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
    assert reader.getRowIndexStride() == 1000
    kinds = {str(s.getKind()) for s in reader.rows().readStripeFooter(reader.getStripes()[0]).getStreamsList()}
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds
    one = token_orc.read(spark, folder).where("doc_id = 6000")
    assert "EqualTo(doc_id,6000)" in one._jdf.queryExecution().executedPlan().toString()
    (row,) = one.collect()
    assert row["ids"] == encoded(["token 2000 " * 20])[0]


def test_token_files_of_nothing(spark, nothing):
    folder = fresh_path(spark, "token-orc-empty")
    token_orc.write(nothing, folder, MODEL)
    assert token_orc.read(spark, folder).count() == 0


def test_numbered_pieces_equal_library_and_start_anew(monkeypatch):
    """Ids copied by number, over several calls and after the numbers start anew; null and empty texts are an end alone."""
    monkeypatch.setattr(token_orc, "CACHE", 30)
    known, library = token_orc.TextIds(open(MODEL).read(), 1), Tokenizer.from_file(MODEL)
    draw = random.Random(3)
    for _ in range(20):
        texts = [None, "", " \n"] + [" ".join("".join(draw.choices("abcÉ'1!中", k=draw.randint(1, 6))) for _ in range(draw.randint(0, 9))) for _ in range(8)]
        ids, counts = known.encode([t if t is None else t.encode() for t in texts])
        want = [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
    assert not known.pieces and known.encode([])[0].tolist() == []


def test_texts_are_cut_as_bytes_like_the_pattern():
    """Many texts at once, parted by arrays as the pattern parts each word; a distinct piece is given to the library once."""
    parts = re.compile(r"[a-zÀ-ÖØ-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\sa-z0-9À-ÖØ-öø-ÿ]+", re.ASCII)
    plain = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ÿ]*")
    draw = random.Random(11)
    for _ in range(3000):
        text = "".join(draw.choices("aSétÀÿrevlmd'''!-_19 \n\x0b\x1c\x00×÷中́", k=draw.randint(0, 14))).encode() + b"\n"
        want = [p for w in text.split() for p in (parts.findall(w.decode().lower()) if plain.fullmatch(w.decode()) else [w.decode()])]
        pieces, begins = token_orc.cut(text)
        assert [p.decode() for p in pieces.to_pylist()] == want and len(begins) == len(want), text
    known, given = token_orc.TextIds(open(MODEL).read(), 1), []
    learn = known.pieces.of
    known.pieces.of = lambda new: given.extend(new.to_pylist()) or learn(new)
    known.encode([b"one two's", None, b"ONE \xe4\xb8\xad two"]), known.encode([b"two \xe4\xb8\xad three"])
    assert given == [b"one", b"two", b"'s", "中".encode(), b"three"]

"""The operators against brute force, their SQL and defined edge cases."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from actlens.llm import (chat, decontaminate, extract, fingerprint, language, lattice, near_dedup, substring_dedup,
                         token_files, warc)
from actlens.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n, vocabulary=4000):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, clashing extra columns."""
    passage = words(900, 70)
    rows = [
        (1, "the cat sat on the mat and the dog ran off " * 3, "en"), (2, None, "en"), (3, "", None), (4, "12 34 !!", "de"),
        (5, "der hund und die katze sind nicht hier " * 3, "de"), (5, "der hund und die katze sind nicht hier " * 3, "de"),
        (6, words(1, 30000), "en"), (7, words(2, 200) + " " + passage + " " + words(3, 200), "en"),
        (8, words(4, 150) + " " + passage + " " + words(5, 90), "en"), (None, "kein name und nicht die nummer", "de"),
        (9, "日本語のテキスト", None), (10, "a", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns(
        {c: F.lit(7) for c in ("segment", "spans", "hit_id", "node", "key", "component", "id", "n_chars")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS FROM '{SMALL}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    a = sorted((tuple(r) for r in got.select(*columns).collect()), key=key)
    b = sorted(want.project(", ".join(columns)).fetchall(), key=key)
    assert a and a == b


def test_phrases_and_proximity(spark, odd):
    items = spark.createDataFrame([(1, "sat on THE mat"), (2, "dog mat"), (None, "ran off"), (3, None), (4, "")], "item_id long, text string")
    index = decontaminate.build_index(odd, segment_words=50)
    hits = {r["doc_id"]: r for r in rows(decontaminate.phrase_hits(index, items)) if r["doc_id"] is not None and r["doc_id"] != 5}
    assert (hits[1]["n_words"], hits[1]["n_hit"], hits[1]["items"]) == (33, 18, ["", "1"])
    assert hits[2]["n_words"] == 0 and hits[6]["n_hit"] == 0
    near = {r["doc_id"]: r for r in rows(decontaminate.proximity_hits(index, items, slop=4)) if r["doc_id"]}
    assert near[1]["items"] == ["", "1", "2"]
    blocks = rows(decontaminate.phrase_hits(index, items, block_bytes=8))
    assert sorted((r["doc_id"] or 0, r["n_hit"]) for r in blocks) == sorted(
        (r["doc_id"] or 0, r["n_hit"]) for r in rows(decontaminate.phrase_hits(index, items)))
    assert sorted(r["doc_id"] or 0 for r in rows(decontaminate.keep_clean(spark, odd, items))) == [0, 2, 3, 4, 5, 5, 6, 7, 8, 9, 10]


def test_proximity_stays_in_one_document(spark):
    docs = spark.createDataFrame([(1, "x red"), (2, "blue y"), (3, ""), (4, "blue z red"), (5, "red")], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, "red blue")], "item_id long, text string")
    hits = rows(decontaminate.proximity_hits(decontaminate.build_index(docs), items, slop=6))
    assert {r["doc_id"]: r["n_hit"] for r in hits} == {1: 0, 2: 0, 3: 0, 4: 3, 5: 0}


def plain_ngrams(text):
    out = collections.Counter()
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        padded = " " + w + " "
        out.update(c for c in w)
        out.update(padded[k:k + 2] for k in range(len(padded) - 1))
        out.update(padded[k:k + 3] for k in range(len(padded) - 2))
    return out


def test_language_profiles(spark, odd):
    code = lambda g: sum((1 if c == " " else ord(c) + 2) << (21 * k) for k, c in enumerate(reversed(g)))
    rank = lambda counts: [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:language.PROFILE]]
    learned = collections.defaultdict(collections.Counter)
    docs = [(r.doc_id, r.text, r.lang) for r in odd.collect()]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 3 == 1
    for d, text, lang in docs:
        if lang and not held(d):
            learned[lang].update(plain_ngrams(text))
    profiles = {x: {g: k for k, g in enumerate(rank(c))} for x, c in learned.items() if c}
    identify = language.identifier(language.learn(odd.where(~language.held_out()).select("lang", "text")))
    got = [(r.text, r.x.lang_pred, r.x.score) for r in odd.select("text", identify(F.col("text")).alias("x")).collect()]
    for text, pred, score in got:
        own = rank(plain_ngrams(text))
        if not own:
            assert (pred, score) == ("und", 0.0)
            continue
        size = language.PROFILE
        far = {x: sum(abs(k - p[g]) if g in p else size for k, g in enumerate(own)) for x, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        assert pred == best and score == pytest.approx(1 - far[best] / (size * len(own)))
    assert [r.x for r in odd.select(language.identifier(language.learn(odd.limit(0)))(F.col("text")).alias("x")).distinct().collect()] == [("und", 0.0)]


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = QUERIES["op2_language"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_blocks():
    page = ('<html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header>site</header><nav><ul><li>menu</ul></nav>'
            '<div class="top ad">buy</div><article><h1>A &amp; B</h1><p>one <b>two</b>\n three<br>four<p>five <script>var t="</p>";</script>six'
            '<div id="comments"><p>me too</p></div><p>seven &lt;x></article><p>after</p><footer>&copy;</footer><a href="x')
    assert extract.blocks(page) == [
        ("chrome", "site"), ("chrome", "menu"), ("chrome", "buy"), ("main", "A & B"), ("main", "one two three"), ("main", "four"),
        ("main", "five six"), ("chrome", "me too"), ("main", "seven <x>"), ("open", "after"), ("chrome", "©")]
    assert extract.blocks("") == [] and extract.blocks("<p>cut <b") == [("open", "cut")]


def test_wrappers_are_no_boilerplate():
    body = "<nav>menu</nav><article><p>text</p><section id='social-history'>history</section><div class='related-work'>work</div></article>"
    want = [("chrome", "menu"), ("main", "text"), ("main", "history"), ("main", "work")]
    for mark in ('class="layout has-sidebar"', 'id="page" class="no-sidebar"', 'class="container with-ads"', 'class="sidebar"', "id=ads"):
        assert extract.blocks(f"<div {mark}>{body}</div>") == want
    assert extract.blocks("<div class='no-sidebar'><p>plain</p></div>") == [("open", "plain")]
    assert extract.blocks("<div class='site-nav'>menu</div><div role='main'>text</div>") == [("chrome", "menu"), ("main", "text")]
    # cards and comments are articles, too; they free no element while the page has its own
    side = '<div class="related"><article>card</article></div><ol class="comments"><article class="comment-body">reply</article></ol>'
    for around in ("{}", '<div class="sidebar">{}</div>'):
        assert extract.blocks(around.format("<article>text</article>" + side)) == [("main", "text"), ("chrome", "card"), ("chrome", "reply")]
    assert extract.blocks('<div id="text">plain</div><div id="comments"><article class="comment">reply</article></div>') == [
        ("open", "plain"), ("chrome", "reply")]


def test_host_runs(spark):
    run = "we use these small files to keep the site fast"
    page = lambda k, body: (k, f"http://h.org/{k}", body)
    pages = spark.createDataFrame([
        page(1, f"<div>{run}</div><p>{words(1, 20)}</p>"), page(2, f"<p>{words(2, 20)}</p><div>{run}</div>"),
        page(3, f"<article><p>{words(3, 9)}</p></article><p>own words</p>"), page(3, f"<article><p>{words(3, 9)}</p></article>"),
        (4, None, f"<div>{run}</div>"), (None, "http://h.org", None)], "page_id long, url string, html string")
    got = sorted((r["page_id"] or 0, r["text"]) for r in rows(extract.main_text(pages)))
    assert got == sorted([(0, ""), (1, words(1, 20)), (2, words(2, 20)), (3, words(3, 9) + "\nown words"), (3, words(3, 9)), (4, run)])


def test_host_runs_of_copies(spark):
    menu, quote = words(40, 12), words(41, 9)
    html = lambda text: f"<div>{menu}</div><p>{text}</p><p>{words(42, 10)}</p>"
    pages = [(1, "a", words(1, 60)), (1, "a", words(1, 60)), (2, "b", words(2, 60)), (3, "b", words(2, 60)),
             *((k, "c", words(3, 60)) for k in (4, 5)), (6, "c", f"{words(6, 20)} {quote} {words(7, 9)}"),
             (7, "c", f"{words(8, 30)} {quote}"), (8, "c", words(9, 50))]
    # copies of 4 and 5 differ in a line of their own
    rows_in = [(k, f"http://{h}/{k}", html(t) + (f"<p>line {k}</p>" if h == "c" else "")) for k, h, t in pages]
    got = sorted((r["page_id"], r["text"]) for r in rows(extract.main_text(spark.createDataFrame(rows_in, "page_id long, url string, html string"))))
    whole = lambda t: f"{menu}\n{t}\n{words(42, 10)}"
    assert got == sorted((k, f"{t}\nline {k}" if h == "c" else whole(t)) for k, h, t in pages)


def test_fingerprints(spark, odd):
    got = rows(fingerprint.compared(odd))
    docs = [(r.doc_id, r.text or "") for r in odd.collect()]
    assert len(got) == len(docs)
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0), reverse=True)
    for (d, text), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        sha = hashlib.sha256((text[:len(text) - half] + after[:half]).encode()).hexdigest()
        assert any(g["doc_id"] == d and g["n_chars"] == len(text) and g["edited_sha256"] == sha for g in got)
    by_text = collections.defaultdict(set)
    for g in got:
        by_text[dict(docs).get(g["doc_id"])].add(g["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_fingerprints_are_stored_as_bytes_once_a_document(spark, odd, monkeypatch):
    kept = {}
    keep = fingerprint.stored
    monkeypatch.setattr(fingerprint, "stored", lambda df, name: kept.setdefault(name, keep(df, name)))
    fingerprint.compared(odd)
    held = rows(kept["fingerprints"])
    assert len(held) == odd.count()
    assert {(len(r["sample"]), len(r["edited_sample"]), len(r["sha"])) for r in held} == {(4 * fingerprint.SAMPLES,) * 2 + (32,)}


def test_fingerprints_estimate_generalised_jaccard(spark):
    a, b = words(1, 400, 60), words(1, 260, 60) + " " + words(2, 140, 60)
    weigh = lambda t: collections.Counter(zip(t.split(), t.split()[1:] + [None]))
    x, y = weigh(a), weigh(b)
    true = sum((x & y).values()) / sum((x | y).values())
    taken = fingerprint.fingerprints(spark.createDataFrame([(1, a), (2, b)], "k int, text string"), ["k"], samples=500)
    one, two = (r.sample for r in taken.orderBy("k").collect())
    assert np.mean([p == q for p, q in zip(one, two)]) == pytest.approx(true, abs=0.08)


def test_fingerprints_of_long_texts(spark):
    rng = np.random.default_rng(8)
    own = [[f"{x:x}" for x in rng.integers(0, 1 << 40, 250_000)] for _ in range(2)]
    texts = [" ".join(own[0]), " ".join(own[1]), " ".join(own[0][:125_000] + own[1][:125_000]), "one word " * 3000, "one word " * 1000]
    taken = fingerprint.fingerprints(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), ["k"], samples=64)
    s = [r.sample for r in taken.orderBy("k").collect()]
    alike = lambda a, b: np.mean([p == q for p, q in zip(s[a], s[b])])
    assert alike(0, 1) == 0 and alike(0, 2) == pytest.approx(1 / 3, abs=0.2) and alike(3, 4) == pytest.approx(1 / 3, abs=0.2)


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([
        (1, "http://a/é", "x\r\n\r\nWARC/1.1\r\n"), (2, None, None), (3, "u", ""), (3, "u", ""), (None, "v", "x\r\n\r\nWARC/1.1\r\n"),
        (5, "w\r\nq", "<p>é</p>")], "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "w"))
    got = rows(warc.assemble(warc.read_warc(spark, str(tmp_path / "w"))))
    assert len(got) == 6 and all(len(g["requests"]) == len(g["metadata"]) == 1 for g in got)
    kinds = collections.Counter((g["metadata"][0]["fields"]["page-id"], g["capture"]["type"], g["metadata"][0]["fields"].get("refers-to-page-id"),
                                 g["capture"]["payload_bytes"], bytes(g["capture"]["payload"] or b"")) for g in got)
    same = b"x\r\n\r\nWARC/1.1\r\n"
    assert kinds == collections.Counter({
        ("1", "response", None, len(same), same): 1, ("", "revisit", "1", len(same), b""): 1, ("2", "response", None, 0, b""): 1,
        ("3", "revisit", "2", 0, b""): 2, ("5", "response", None, 9, "<p>é</p>".encode()): 1})


def plain_components(docs):
    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(docs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(docs):
        if d is not None:
            least[find(k)] = min(least.get(find(k), d), d)
    return sorted(((d if d is not None else -1), len(sets[k]), (c if (c := least.get(find(k))) is not None else -1))
                  for k, (d, _) in enumerate(docs))


def test_near_duplicates(spark, odd):
    rng = np.random.default_rng(3)
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    for group in range(30):
        base = words(group + 50, int(rng.integers(3, 120))).split()
        for k in range(int(rng.integers(2, 12))):
            own = list(base)
            for _ in range(int(rng.integers(0, 4))):
                own[int(rng.integers(len(own)))] = f"x{rng.integers(99)}"
            docs.append((1000 + 100 * group + k, " ".join(own)))
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1)
                   for r in got.collect())
    assert found == plain_components(docs)


def test_chat_round_trip(spark):
    texts = ["", None, "a\\", "<|im_end|>\n<|im_start|>assistant x", "\\n", "é" * 200, "<|<|\\<|"]
    convs = spark.createDataFrame([(k % 3, k // 3, r, t) for k, (t, r) in enumerate(
        (t, r) for t in texts for r in ("user", "assistant", None, "a\nb"))] + [(None, None, "user", "x"), (1, 2, "user", "same"), (1, 2, "user", "same")],
        "conv_id long, turn long, role string, text string")
    final = rows(chat.messages(chat.event_log(convs)))
    key = lambda r: (r["conv_id"] is not None, r["conv_id"] or 0, r["turn"] or 0, r["role"] or "", r["text"] or "")
    want = sorted(rows(convs), key=key)
    assert [(r["role"], r["text"]) for r in sorted(final, key=key)] == [(r["role"] or "", r["text"] or "") for r in want]
    got = {r["conv_id"]: r for r in rows(chat.read_back(chat.formatted(chat.messages(chat.event_log(convs)))))}
    for conv in {r["conv_id"] for r in want}:
        own = [(r["role"] or "", r["text"] or "") for r in want if r["conv_id"] == conv]
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256("".join(b for a, b in own if a == "assistant").encode()).hexdigest()


def test_token_files(spark, odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_files.TOKENIZER)
    tokenizer = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(100, "a   b \n c <|endoftext|> d"), (101, " x\n y　 z ")], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(extra)
    got = rows(token_files.read_token_files(*token_files.write_token_files(docs, path)))
    start = 0
    texts = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    want = []
    for d, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        want.append({"doc_id": d, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())})
        start += len(ids)
    assert sorted(got, key=lambda r: r["start"]) == want


def test_token_blocks_decode_alone():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.geometric(0.01, 5000), 3000)
    freq = token_files.scaled(np.bincount(ids))
    content = token_files.encode_shard(ids, [1, None], [2000, 3000], freq, block_ids=700, lanes=16)
    layout = token_files.Table(freq)
    doc_ids, counts, found = token_files.decode_shard(content, layout)
    assert doc_ids == [1, None] and counts.tolist() == [2000, 3000] and (found == ids).all()
    assert (token_files.decode_shard(content, layout, [3])[2] == ids[2100:2800]).all()
    broken = bytearray(content)
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        token_files.decode_shard(bytes(broken), layout)


def test_sampling_without_replacement():
    vocab = lattice.vocabulary(public_tokenizers.path(lattice.MODEL), lattice.ALPHA)
    names = lattice.units("the cat")
    built = lattice.Lattices(vocab, names)

    def ways(node, done, log_prob):
        if built.is_end[node]:
            yield done, log_prob
        for piece, after, weight in built.edges(node):
            yield from ways(after, (*done, piece), log_prob + weight)

    prob = {(): 1.0}
    for u in range(len(names)):
        own = dict(ways(int(built.first[u]), (), -float(built.sum[built.first[u]])))
        prob = {a + b: p * math.exp(q) for a, p in prob.items() for b, q in own.items()}
    assert sum(prob.values()) == pytest.approx(1, abs=1e-5)
    n = 3000
    drawn = [[tuple(s[0].tolist()) for s in found] for found in lattice.segmentations(["the cat"] * n, list(range(n)), vocab, 2)]
    assert all(len(set(d)) == 2 for d in drawn)
    first, second = collections.Counter(d[0] for d in drawn), collections.Counter(d[1] for d in drawn)
    after = {s: sum(prob[f] * p / (1 - prob[f]) for f in prob if f != s) for s, p in prob.items()}
    assert max(abs(first[s] / n - p) for s, p in prob.items()) < 0.04
    assert max(abs(second[s] / n - p) for s, p in after.items()) < 0.04
    few = next(lattice.segmentations(["a"], [1], vocab, 5))
    assert len({tuple(s[0].tolist()) for s in few}) == len(few) and few[0][3] == 1.0 or len(few) == 5


def test_lattices_hold_edges_alone():
    vocab = lattice.vocabulary(public_tokenizers.path(lattice.MODEL), lattice.ALPHA)
    names = [" the", "\n", "日本", " x\U0001f600y", " "]
    built = lattice.Lattices(vocab, names)
    edges = [e for node in range(len(built.is_end)) for e in built.edges(node)]
    assert len(edges) == len(built.piece) == len(built.cdf) < 2 * len("".join(names))


def test_units_are_numbered_as_they_are_cut():
    texts = ["", "  a  b\n c", "\n\n ", " ", "日本 ▁x", "a b a b", "\ud800 y"]
    (joined, lens), flat, stops = lattice._numbered(texts)
    ends = np.cumsum(lens)
    names = [joined[e - n:e] for e, n in zip(ends.tolist(), lens.tolist())]
    assert len(set(names)) == len(names)
    assert [[names[k] for k in flat[a:b]] for a, b in zip(stops, stops[1:])] == [lattice.units(t) for t in texts]


def test_pieces_decode(spark, odd):
    found = rows(lattice.sampled(odd, digests=True))
    assert len(found) == odd.count() and all(r["round_trip"] for r in found)
    none = [r for r in found if r["doc_id"] in (2, 3)]
    assert all(r["n_samples"] == 1 and r["n_tokens"] == [0] for r in none)
    vocab = lattice.vocabulary(public_tokenizers.path(lattice.MODEL), lattice.ALPHA)
    for text in ("Überall  gibt es\nété 日本 \U0001f600", "x"):
        assert lattice.decode(lattice.encode(text, vocab), vocab) == text
        for ids, *_ in next(lattice.segmentations([text], [5], vocab, 3)):
            assert vocab.processor.decode(ids.tolist()) == text


def test_repeats_are_cut(spark, odd):
    got = {r["doc_id"]: r for r in rows(substring_dedup.without_repeats(odd.where("doc_id <> 5"), segment_bytes=2000))}
    assert got[7]["text"].count("w") == 470 and got[7]["spans_2"] == []
    whole = {r.doc_id: r.text for r in odd.collect()}
    spans = got[8]["spans_2"]
    assert len(spans) == 1 and 55 <= len(whole[8][spans[0]["from"]:spans[0]["to"]].split()) <= 70
    kept = whole[8][:spans[0]["from"]] + whole[8][spans[0]["to"]:]
    assert got[8]["text"] == kept and got[2]["text"] is None and got[3]["text"] == "" and got[8]["spans"] == 7
    moved = "inserted words " + whole[7]
    data = [np.frombuffer(t.encode(), np.uint8) for t in (whole[7], moved)]
    a, b = (set(substring_dedup.units(d)[2].tolist()) for d in data)
    assert len(a - b) <= 4


def test_periodic_passages_are_cut(spark):
    rng = np.random.default_rng(5)
    names = ["buy now ", "spam ", "a ", *("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) + " " for _ in range(60))]
    docs = [(k + 1000 * copy, f"{words(2 * k + copy, 40, 10**9)} {name * 60}{words(900 + 2 * k + copy, 40, 10**9)}")
            for k, name in enumerate(names) for copy in (0, 1)]
    got = {r["doc_id"]: r for r in rows(substring_dedup.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")))}
    for k, name in enumerate(names):
        repeated = 60 * len(name)
        cut = sum(s["to"] - s["from"] for s in got[k + 1000]["spans"])
        assert got[k]["spans"] == [] or len(name) < 4
        assert repeated - 110 <= cut <= repeated, name


def test_passages_with_few_spaces_are_cut(spark):
    rng = np.random.default_rng(6)
    signs = lambda n: "".join(chr(0x4E00 + c) for c in rng.integers(0, 5000, n))
    passage = signs(400) + "\n" + signs(500) + " " + signs(300)
    docs = [(k, signs(200) + passage + signs(150)) for k in (1, 2)]
    got = {r["doc_id"]: r for r in rows(substring_dedup.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")))}
    assert got[1]["spans"] == [] and len(got[2]["spans"]) == 1
    s = got[2]["spans"][0]
    assert 200 <= s["from"] <= 250 and 1350 <= s["to"] <= 1402
    assert got[2]["text"] == docs[1][1][:s["from"]] + docs[1][1][s["to"]:]


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = public_tokenizers.path(token_files.TOKENIZER)
    for df in (decontaminate.phrase_hits(decontaminate.build_index(empty), items), language.keep_identified(spark, empty),
               extract.main_text(pages), fingerprint.compared(empty), near_dedup.near_duplicates(empty),
               token_files.read_token_files(*token_files.write_token_files(empty, path)), lattice.sampled(empty),
               substring_dedup.without_repeats(empty)):
        assert df.count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    base, passage = words(20, 300), words(21, 80)
    leak = words(22, 30)
    docs = [(k, words(100 + k, 120), "en") for k in range(6)] + [
        (10, base, "en"), (11, base + " extra", "en"), (20, words(30, 90) + " " + passage, "en"), (21, passage + " " + words(31, 90), "en"),
        (30, words(32, 50) + " " + leak + " " + words(33, 50), "en"), (40, "123 !!", None), (41, None, "en")]
    pq.write_table(pa.table({"doc_id": [d[0] for d in docs], "text": [d[1] for d in docs], "lang": [d[2] for d in docs],
                             "source": ["s"] * len(docs), "n_chars": [len(d[1] or "") for d in docs]}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": [1], "text": [leak]}), tmp_path / "benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == [0, 1, 2, 3, 4, 5, 10, 20, 21] and all(r.round_trip for r in out)
    vocab = lattice.vocabulary(public_tokenizers.path(lattice.MODEL), lattice.ALPHA)
    texts = {r.doc_id: lattice.decode(r.ids[0], vocab) for r in out}
    assert texts[0] == docs[0][1] and passage in texts[20] and len(texts[21].split()) < 110
    docs_columns = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs_columns, str(tmp_path)).columns == docs_columns.columns

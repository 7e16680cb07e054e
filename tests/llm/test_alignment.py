"""External counting against counters; alignments against plain Python over whole texts."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from actlens.llm import alignment, spill

SMALL = "/root/testdata/sf0.001"


def test_runs_and_merge():
    rng = np.random.default_rng(3)
    want, blocks, rows = collections.Counter(), collections.defaultdict(list), collections.Counter()
    for _ in range(9):
        n = int(rng.integers(1, 4000))
        left, right = rng.zipf(1.3, n) % 300, rng.integers(0, 40, n)
        docs, times = rng.integers(0, 200, n), rng.integers(1, 5, n)
        pairs = left * spill.WIDTH + right
        per_doc = collections.Counter()
        for p, d, t in zip(pairs.tolist(), docs.tolist(), times.tolist()):
            per_doc[p, d] += t
        want.update(p for p, _ in per_doc)
        back = collections.Counter()
        for radix, first, section, doc_section in spill.cut_runs(*np.unique(pairs, return_inverse=True), docs, times, 7):
            own, n_docs = spill.unpack_pairs(section)
            assert first == own[0] and (np.diff(own) > 0).all() and (spill.radix_of(own // spill.WIDTH, 7) == radix).all()
            for k, d, t in zip(*(x.tolist() for x in spill.run_documents(n_docs, doc_section))):
                back[int(own[k]), d] += t
            blocks[radix] += [(own[a:a + 11], n_docs[a:a + 11]) for a in range(0, len(own), 11)]
        assert back == per_doc
    top = collections.Counter()
    for p, n in want.items():
        top[p // spill.WIDTH] = max(top[p // spill.WIDTH], n)
    for radix, parts in blocks.items():
        parts.sort(key=lambda b: int(b[0][0]))
        last = -1
        for p, n, best in spill.with_maxima(spill.merge(iter(parts))):
            assert p[0] > last and (np.diff(p) > 0).all()
            last = int(p[-1])
            for x, y, z in zip(p.tolist(), n.tolist(), best.tolist()):
                rows[x] = y
                assert z == (y == top[x // spill.WIDTH])
    assert rows == want


def by_hand(docs):
    """Straight from the definition, over whole texts."""
    a_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = alignment.byte_letters()
    a_names = {i: t for t, i in a_side.get_vocab().items()}
    found, held = [], collections.Counter()
    for doc_id, text in docs:
        want = b" " + (text or "").encode()
        a = a_side.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        a_bytes = [bytes(letters.get(c, 0) for c in a_names[i]) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode()
                   for i, p in ((i, b_side.id_to_piece(i)) for i in b)]
        if b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            a, b = [], []
        groups, i, j, end_a, end_b = [], 0, 0, 0, 0
        while i < len(a):
            xs, ys = [], []
            while not xs or end_a != end_b:
                if end_a <= end_b:
                    xs.append(a[i]); end_a += len(a_bytes[i]); i += 1
                else:
                    ys.append(b[j]); end_b += len(b_bytes[j]); j += 1
            groups.append((xs, ys))
        links = collections.Counter((x, y) for xs, ys in groups for x in xs for y in ys)
        held.update(links.keys())
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        found.append((doc_id, len(a), len(b), len(groups), links, text))
    top = collections.Counter()
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    return sorted(((d, na, nb, ng, sum(links.values()), sum(m for p, m in links.items() if held[p] == top[p[0]]),
                    sum(m * held[p] for p, m in links.items()), t) for d, na, nb, ng, links, t in found), key=repr), held


def odd_rows():
    rng = np.random.default_rng(6)
    letters = list("abeinrst") * 3 + list("  \n\t.,'0é日ß") + ["▁", "　", "\x00", "\x1f", " ", "\U0001f600", "<s>", "<0x41>", "<|endoftext|>", "\r\n"]
    rows = [(k, "".join(rng.choice(letters, int(rng.integers(1, 120))))) for k in range(300)]
    rows += [(k, "".join(rng.choice(list("abeinrst     .,'0éß"), int(rng.integers(1, 200))))) for k in range(300)]
    plain = "the cat's house wasn't re-built in 1999, naïve Größe façade"
    rows += [(None, plain), (None, plain), (7, plain), (7, plain), (8, ""), (9, None), (10, " "), (11, "a  b"), (12, "end "), (13, "日本語のテキスト" * 40),
             (14, "x" * 5000), (15, (plain + " ") * 3000 + "end"), (16, "word " + "y" * 300 + " word"), (17, "▁x"), (18, "a\n b \nc")]
    return rows


def rows_of(df):
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_against_definition(spark, monkeypatch, small):
    docs = odd_rows()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns(
        {c: F.lit(3) for c in ("slice", "at", "radix", "pairs", "docs", "groups", "n_a", "sums")})
    want, held = by_hand(docs)
    if small:
        got, counts = alignment.align(df.repartition(40), radices=3, fan=2, group=2)
    else:
        got, counts = alignment.align(df)
    assert rows_of(got) == want
    assert {(r.left, r.right): r.documents for r in alignment.pair_counts(counts).collect()} == dict(held)


def test_records_in_parts():
    """A slice whose records are made in parts gives the same records, each pair in one run of the slice."""
    aligner = alignment.aligner_of(*alignment.tokenizer_paths())
    slices = []
    for _ in range(2):
        held = alignment._Slice(aligner, False)
        for doc_id, text in odd_rows():
            words = (text or "").split(" ")
            aligner.learn(set(words))
            held.add(doc_id, text or "", words)
        slices.append(held)

    def records(held, most):
        out, seen = collections.Counter(), collections.Counter()
        for _, _, section, docs in held.runs(5, most):
            own, n = spill.unpack_pairs(section)
            seen.update(own.tolist())
            for k, d, t in zip(*(x.tolist() for x in spill.run_documents(n, docs))):
                out[int(own[k]), d] += t
        assert max(seen.values()) == 1
        return out

    assert records(slices[0], 1 << 21) == records(slices[1], 900)


def test_empty_tables(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"))[0].collect() == []
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert rows_of(alignment.align(only)[0]) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in by_hand(docs)[0]]
    assert rows_of(alignment.op13_alignment(spark, SMALL).withColumnRenamed("groups_sha256", "groups")) == want

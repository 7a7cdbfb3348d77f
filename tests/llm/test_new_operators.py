"""Packing, Merkle manifest and source audit against brute force, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.llm import merkle_manifest, packing
from assay.llm.merkle_manifest import folded, leaf, manifest, proof_digest
from assay.llm.packing import Encoder, best_cuts, candidates, packed
from assay.llm.source_audit import divergence

P = pytest.importorskip("public_tokenizers")
PATH = str(P.path("byte_bpe_50k.json"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, d string, tree string, pos string, rank string"


def table(spark, rows, parts=3):
    """rows: doc_id, text, lang, source, n_chars; the other columns' names clash with those of the operators."""
    full = [(*r, "a", "b", "c", "d", "e") for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts) if rows else spark.createDataFrame([], SCHEMA)


ODD_TEXTS = [
    None, "", " ", "\n", "a", "  two  spaces  ", "line one.\nline two.\n\n\nline  five \n ", "tab\tand no-break   x   y\n \nz", "中文。句子 　 全角", "it's 12,345.67% — don't",
    " wide spaces  ", "é <|endoftext|> x", "\r\ncarriage\r\n", "x\x1c y \x85 z", "a." * 3000, "Word and word. " * 900, "no\nspace\nat\nall", " lead", "trail ", " \nq", ".\nA", "\n\nB",
]


def odd_rows(seed=3):
    rng = random.Random(seed)
    texts = ODD_TEXTS + [" ".join(rng.choice(["alpha", "beta.", "Gamma!\n", "δέλτα", "x,"]) for _ in range(rng.choice([1, 9, 300, 4000]))) for _ in range(25)]
    rows = [(500 - 3 * i, x, [None, "en", "", "zé", "de"][i % 5], [None, "s", "", "s2"][i % 4], None if i % 6 == 5 else len(x or "")) for i, x in enumerate(texts)]
    return [*rows, rows[5], rows[5], (None, "anon", None, None, None), (None, "anon", None, None, None), (7, "one", "solo", "only", 3)]


# ---- packing

def test_pieces_hold_the_tokenizers_ids(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(PATH)
    model.encode_special_tokens = True
    rows = odd_rows()
    got = [r.asDict() for r in packed(table(spark, rows), PATH).collect()]
    want = Counter(tuple([*model.encode(x or "", add_special_tokens=False).ids, 0]) for _, x, *_ in rows)
    by_seq, parts = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(ids) == r["length"] > 0
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        parts[r["doc_id"], r["doc_tokens"]].append((r["start"], ids))
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    have = Counter()
    for (doc, n), pieces in parts.items():
        pieces.sort(key=lambda p: p[0])
        whole = [x for _, ids in pieces for x in ids.tolist()]
        copies = len(whole) // n
        if copies == 1:
            have[tuple(whole)] += 1
        else:  # repeated rows and null ids: all of them are short and in one piece
            assert all(s == 0 for s, _ in pieces)
            for _, ids in pieces:
                have[tuple(ids.tolist())] += 1
    assert have == want


def test_padding_is_little(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["some", "words", "here.", "and", "there,"]) for _ in range(rng.choice([20, 200, 900]))), None, None, None) for i in range(400)]
    used = Counter()
    for r in packed(table(spark, rows, 1), PATH).select("sequence_id", "length").collect():
        used[r.sequence_id] += r.length
    pad = sum(0 if n & (n - 1) == 0 else 1024 - n for n in used.values())
    assert pad < 0.02 * sum(used.values())


def test_cuts_are_the_best_ones():
    rng = np.random.default_rng(2)
    for _ in range(20):
        end = np.cumsum(rng.integers(1, 90, 12))
        sentence = np.unique(rng.integers(1, end[-1], 8))
        place, price = candidates(end, sentence, True, 64)
        assert np.diff(place).max() <= 64

        def cost(i, j):
            n = int(place[j] - place[i])
            return None if n > 64 else 0 if n & (n - 1) == 0 and n >= packing.LEAST_POWER else 64 - n

        best = [0]
        for j in range(1, len(place)):
            best.append(min(best[i] + (price[i] if i else 0) + c for i in range(j) if (c := cost(i, j)) is not None))
        cuts = best_cuts(place, price, 64)
        assert cuts[0] == 0 and cuts[-1] == len(place) - 1
        assert sum(cost(i, j) for i, j in zip(cuts, cuts[1:])) + sum(price[i] for i in cuts[1:-1]) == best[-1]


def test_blocks_go_on_where_the_last_one_ended(spark, monkeypatch):
    """Documents longer than a block, and blocks of few tokens: every token once, sequences of 64 at most."""
    monkeypatch.setattr(packing, "BLOCK", 300)
    from pyspark import TaskContext

    monkeypatch.setattr(packing, "TaskContext", type("C", (), {"get": staticmethod(lambda: type("X", (), {"partitionId": staticmethod(lambda: 2)}))}))
    stream, rng, seen, sizes = packing._Stream(64), np.random.default_rng(1), defaultdict(list), Counter()
    docs = [rng.integers(0, 99, rng.choice([1, 30, 200, 2000])).astype(np.uint32) for _ in range(60)]
    outs = []
    for d, ids in enumerate(docs):
        stream.add(d, ids, np.arange(7, len(ids), 11))
        if stream.size >= 300:
            outs.append(stream.pack(False))
    outs.append(stream.pack(True))
    for names, (start, size, number, offset, whole, blobs) in outs:
        for row in zip(names, start, size, number, offset, whole, blobs):
            seen[row[0]].append((int(row[1]), np.frombuffer(row[6], "<u4")))
            sizes[row[3]] += row[2]
            assert row[5] == len(docs[row[0]])
    assert max(sizes.values()) <= 64 and min(sizes) == 2 << 33
    for d, ids in enumerate(docs):
        assert np.array_equal(np.concatenate([x for _, x in sorted(seen[d], key=lambda p: p[0])]), ids)


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    enc = Encoder(PATH)
    text = b"one two three four five six seven. " * 3
    first = enc(np.array([0, len(text)]), np.frombuffer(text, np.uint8))[0]
    assert not len(enc.key)
    assert np.array_equal(first, enc(np.array([0, len(text)]), np.frombuffer(text, np.uint8))[0])


def test_packing_of_nothing(spark):
    assert packed(table(spark, []), PATH).count() == 0
    assert [tuple(r) for r in packed(table(spark, [(1, None, None, None, None)], 1), PATH).select("doc_id", "start", "length", "doc_tokens", "offset").collect()] == [(1, 0, 1, 1, 0)]


# ---- Merkle manifest

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def by_hand(rows):
    """doc_id, leaf, subroot, root, proof, folded root of all rows, as the definition says it."""
    def text(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def of(d, x, lang, source, n):
        return h(*map(text, (d, source, lang, n, x)))

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            now = levels[-1]
            levels.append([h(*now[i : i + 2]) for i in range(0, len(now), 2)])
        paths = [[(lv[(i >> k) ^ 1] if (i >> k) ^ 1 < len(lv) else "", bool((i >> k) & 1)) for k, lv in enumerate(levels[:-1])] for i in range(len(leaves))]
        return levels[-1][0], paths

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, of(*r)))
        trees[lang] = (own, *tree([of(*r) for r in own]))
    root, over = tree([trees[x][1] for x in langs])
    out = []
    for lang, up in zip(langs, over, strict=True):
        own, subroot, paths = trees[lang]
        for r, path in zip(own, paths, strict=True):
            whole = path + up
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = of(*r[:4], r[4] + 1) if bad and r[4] is not None else of(*r)
            for sibling, left in whole:
                now = h(sibling, now) if left else h(now, sibling)
            out.append((r[0], of(*r), subroot, root, h(*(s for s, _ in whole)), now))
    return Counter(out)


@pytest.mark.parametrize("levels", [10, 1, 3])
def test_manifest(spark, monkeypatch, levels):
    """The same digests whatever the levels of a pass; several passes where they are few."""
    monkeypatch.setattr(merkle_manifest, "LEVELS", levels)
    rows = odd_rows()
    bad = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    made = manifest(table(spark, rows), F.when(bad, leaf(n_chars=F.col("n_chars") + 1)))
    got = made.proofs().select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")), folded(F.col("path"), F.coalesce("changed", "leaf")))
    assert Counter(map(tuple, got.collect())) == by_hand(rows)
    assert {r.level for r in made.store.nodes.select("level").distinct().collect()} <= set(range(levels + 1))


def test_manifest_of_few_rows(spark):
    assert manifest(table(spark, [])).proofs().count() == 0
    one = [(1, "x", None, "s", 1)]
    r = manifest(table(spark, one, 1)).proofs().first()
    assert r.leaf == r.subroot == r.root and r.path == []


# ---- source audit

def audit_by_hand(rows, least, top):
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", x or "")]) for _, x, lang, source, _ in rows]
    out = Counter()
    for lang in {d[0] for d in docs}:
        df, counts = Counter(), defaultdict(Counter)
        for _, source, terms in (d for d in docs if d[0] == lang):
            df.update(set(terms))
            counts[source].update(terms)
        kept = sorted((t for t in df if df[t] >= least), key=str.encode)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        for s in counts:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s), key=lambda x: (x[0], x[1].encode()))
            terms = sorted(((q[t] - p[s][t], t) for t in kept if counts[s][t] and p[s][t] > q[t]), key=lambda x: (x[0], x[1].encode()))[:top]
            out.update((lang, s, "pair", o, -v, k) for k, (v, o) in enumerate(pairs, 1))
            out.update((lang, s, "term", t, -v, k) for k, (v, t) in enumerate(terms, 1))
    return out


@pytest.mark.parametrize(("least", "top", "shard"), [(2, 3, 1_000), (3, 50, 7), (10_000, 5, 7)])
def test_divergence(spark, monkeypatch, least, top, shard):
    from assay.llm import source_audit

    monkeypatch.setattr(source_audit, "SHARD_ROWS", shard)
    rng = random.Random(8)
    rows = odd_rows() + [(i, " ".join(rng.choice(["Aa", "aA", "bé", "CÉ", "d1e", "ff", "g_g", f"w{chr(97 + i % 26)}"]) for _ in range(30)), ["en", None, "fr"][i % 3], f"s{i % 5}", 1) for i in range(90)]
    got = divergence(table(spark, rows), least, top).select("lang", "source", "part", "item", "value", "rank")
    assert Counter(map(tuple, got.collect())) == audit_by_hand(rows, least, top)


def test_divergence_of_nothing(spark):
    assert divergence(table(spark, [])).count() == 0
    assert divergence(table(spark, [(1, None, None, None, None)], 1)).count() == 0

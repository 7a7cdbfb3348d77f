"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assay.llm._components import components
from assay.llm._repeats import Units, _parts_of, _wanted, runs_of, with_uid
from assay.llm._state import keep
from assay.llm._text import BYTE, Lines, Words, prefix, spans, utf8
from assay.llm.decontaminate import find_items
from assay.llm.line_crf import COUNTS, content_lines, fit, joined_chains, line_quality, train, viterbi
from assay.llm.line_dedup import _SORTED, LineRuns, dedup_lines
from assay.llm.mixing import WEIGHTS, mix, targets
from assay.llm.quality_knn import fit as fit_terms
from assay.llm.quality_knn import quality_scores, term_matrix
from assay.llm.radix_dedup import remove_repeats
from assay.llm.sketch_join import jaccard_stage, offered, pieces, similar_components
from assay.llm.suffix_dedup import remove_repeated_words, subtrees
from assay.llm.tool_calls import link_calls, orphan_results, schema_table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, size string, id string, t string, uid string, matches string, node string"


def table(spark, texts, first=0, parts=3):
    rows = [(d, x, None, None if i % 7 == 3 else f"s{i % 4}", None, "a", "b", "c", "d", "e", "f", "g", "h") for i, (d, x) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts) if rows else spark.createDataFrame([], SCHEMA)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.1 else f"W{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=1):
    """Random texts, exact and near copies, shared passages, odd rows; ids are not in order."""
    rng = random.Random(seed)
    texts = [words(rng, rng.choice([3, 12, 60, 200])) for _ in range(40)]
    passage = words(rng, 70)
    for i in range(0, 40, 3):
        at = rng.randrange(len(texts[i]) + 1)
        texts[i] = texts[i][:at] + passage + texts[i][at:]
    for i in range(12):
        near = list(texts[i])
        for _ in range(rng.choice([0, 1, 2, 4, 9])):
            near[rng.randrange(len(near))] = "changed"
        texts.append(near)
    joined = ["".join(w + rng.choice([" ", "  ", "\n", "\t "]) for w in x) for x in texts]
    rows = [(1000 - 7 * i, x) for i, x in enumerate(joined)]
    rows += [(5, None), (6, ""), (7, " \n\t\n "), (None, joined[0]), (None, None), (rows[3][0], rows[3][1]), (8, "one two"), (9, "one TWO"), (10, "Orre " * 400), (11, " ".join(words(rng, 9000)))]
    return rows


# ---- line CRF

def test_counts(spark):
    rows = corpus()
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = line_quality(table(spark, rows), labels)
    want = Counter()
    for d, text in rows:
        w = WORD.findall(text or "")
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        want[d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit), failed, not failed] += 1
    assert Counter(tuple(r) for r in out.select("doc_id", *COUNTS[:-1], "base_failed", "kept").collect()) == want
    assert set(SCHEMA.replace("kept string, ", "").split(", ")) <= {f"{n} {t}".replace("bigint", "long") for n, t in out.dtypes}


def test_crf_separates_junk(spark):
    rng = random.Random(2)
    good = [(i, "\n".join(" ".join(words(rng, 12)) + "." for _ in range(6))) for i in range(60)]
    junk = [(100 + i, "\n".join(" ".join(w.upper() + "!! | ***" for w in words(rng, 9)) for _ in range(6))) for i in range(60)]
    labels = spark.createDataFrame([(d, int(d < 100), 0) for d, _ in good + junk if d % 2], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in line_quality(table(spark, good + junk), labels).collect()}
    assert all(kept[d] for d, _ in good) and not any(kept[d] for d, _ in junk)


def test_viterbi_is_exact():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    model = {"start": rng.normal(size=2), "trans": rng.normal(size=(2, 2))}
    sizes = [1, 5, 0, 3, 7]
    emit, first = rng.normal(size=(16, 2)), np.concatenate(([0], np.cumsum(sizes)))
    got = viterbi(emit, first, model)
    for d, n in enumerate(sizes):
        e = emit[first[d] : first[d + 1]]
        score = lambda s: model["start"][s[0]] + sum(e[i, x] for i, x in enumerate(s)) + sum(model["trans"][x, y] for x, y in zip(s, s[1:], strict=False))  # noqa: B023, E731
        if n:
            assert tuple(got[first[d] : first[d + 1]]) == max(itertools.product((0, 1), repeat=n), key=score)


def test_crf_learns_transitions():
    model = fit(*joined_chains([np.zeros((6, 10), int)] * 10 + [np.ones((6, 10), int)] * 10, [0] * 10 + [1] * 10))
    assert model["trans"][0, 0] > model["trans"][0, 1] and model["emit"][1, 1] > model["emit"][1, 0]


def good_lines(rng, n):
    return [" ".join(words(rng, rng.randint(6, 14))) + "." for _ in range(n)]


def junk_lines(rng, n):
    return [" ".join(w.upper() + rng.choice(["!!", " |", "***"]) for w in words(rng, rng.randint(6, 14))) for _ in range(n)]


def test_lines_of_mixed_documents_are_told_apart(spark):
    """Trained on documents of one kind only, the chain marks the right lines of documents of both."""
    rng = random.Random(3)
    pure = [(i, "\n".join((good_lines if i % 2 else junk_lines)(rng, rng.randint(1, 9)))) for i in range(160)]
    labels = spark.createDataFrame([(d, d % 2, 0) for d, _ in pure], "doc_id long, quality int, toxic int")
    mixed, want = [], {}
    for i in range(40):
        kinds = [rng.random() < 0.5] * rng.randint(2, 5) + [rng.random() < 0.5] * rng.randint(2, 5) + [True] * 3
        lines = [(good_lines if k else junk_lines)(rng, 1)[0] for k in kinds]
        n = [len(WORD.findall(x)) for x in lines]
        mixed.append((1000 + i, "\n".join(lines)))
        want[1000 + i] = sum(x for x, k in zip(n, kinds, strict=True) if k), sum(n), kinds
    odd = [(2000, None), (2001, ""), (2002, " \n\n\t"), (2003, "\n".join(good_lines(rng, 3000))), (2004, "\n".join(junk_lines(rng, 3000))), (None, mixed[0][1]), mixed[0]]
    docs = table(spark, pure + mixed + odd)
    out = line_quality(docs, labels).collect()
    got = {r.doc_id: r for r in out}
    right = [d for d, (content, n, _) in want.items() if got[d].n_content_words == content and got[d].n_words == n]
    assert len(out) == len(pure + mixed + odd) and len(right) >= 0.95 * len(want)
    between = [d for d, (content, n, _) in want.items() if content < n]
    assert len(between) > 20 and all(0 < got[d].content_share < 1 for d in between)
    model = train(docs, labels)
    off, data = utf8(pa.array([x for _, x in mixed]))
    lines = Lines(off, data)
    marks = content_lines(off, data, lines, Words(off, data), model)
    assert np.mean(marks == np.concatenate([want[1000 + i][2] for i in range(40)])) > 0.98
    assert [(got[d].n_words, got[d].n_content_words, got[d].content_share, got[d].kept) for d in (2000, 2001, 2002)] == [(0, 0, 0.0, False)] * 3
    assert got[2003].content_share > 0.99 and got[2003].kept and got[2004].content_share < 0.01 and not got[2004].kept
    assert got[None].content_share == got[1000].content_share


# ---- tool calls

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, after array<string>"
RESULTS = "conv_id long, call_id string, turn long, content string"


def test_tool_calls(spark):
    tools = {"f": {"x": ("integer", True), "y": ("string", False), "z": ("object", False), "q": ("number", False)}}
    calls = [
        (1, "a", 1, "f", '{"x": 1, "q": 2.5, "z": {"b": 1, "a": [2,  3]}}', None), (1, "b", 2, "f", '{"x": 1.5, "y": null}', ["a"]), (1, "c", 3, "f", '{"y": 3, "w": 1}', ["b", None, "b"]), (1, "d", 4, "g", "{}", ["c"]),
        (1, "e", 5, "f", "[1]", ["none"]), (2, "p", 1, "f", '{"x": 1}', ["q"]), (2, "q", 2, "f", '{"x": 1}', ["p"]), (2, "r", 3, "f", '{"x": 1}', ["q"]), (2, "s", 3, "f", None, ["s"]), (3, "a", 9, "f", '{"x": 2}', None), (3, "a", 8, "f", '{"x": 3}', []), (None, "a", 1, "f", "{}", None), (4, None, 1, "f", "{}", None), (5, "a", None, None, None, None),
    ]
    results = [(1, "a", 2, "r1"), (1, "a", 1, "r0"), (1, "zz", 1, "lost"), (None, "a", 1, "x"), (2, "r", None, None)]
    c = spark.createDataFrame([(*x, "extra") for x in calls], CALLS + ", level string")
    r = spark.createDataFrame(results, RESULTS)
    schemas = schema_table(spark, tools)
    out = {(x.conv_id, x.call_id): x for x in link_calls(c, r, schemas).collect()}
    assert {k: v.level for k, v in out.items()} == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (1, "d"): 3, (1, "e"): 0, (2, "p"): None, (2, "q"): None, (2, "r"): None, (2, "s"): None, (3, "a"): 0, (5, "a"): 0}
    assert {k: v.errors for k, v in out.items() if k[0] == 1} == {(1, "a"): [], (1, "b"): ["type of x"], (1, "c"): ["missing x", "type of y", "unknown w"], (1, "d"): ["unknown tool"], (1, "e"): ["not an object", "unknown after"]}
    assert out[2, "p"].errors == ["cycle"] and out[2, "s"].errors == ["not an object", "cycle"] and out[5, "a"].errors == ["unknown tool"]
    assert out[1, "a"].record == '{"after":[],"arguments":{"q":2.5,"x":1,"z":{"a":[2,3],"b":1}},"call_id":"a","conv_id":1,"level":0,"name":"f","result":"r0","turn":1}'
    assert out[1, "a"].n_results == 2 and out[3, "a"].turn == 8
    assert {(x.conv_id, x.call_id) for x in orphan_results(c, r).collect()} == {(1, "zz"), (None, "a")}
    assert link_calls(c.limit(0), r.limit(0), schemas).count() == 0


def test_calls_that_use_several_results(spark):
    """Levels of random graphs against the longest path, cycles among them."""
    rng = random.Random(4)
    calls, uses = [], {}
    for conv in range(6):
        for i in range(14):
            after = rng.sample(range(14) if conv == 5 else range(i), min(i, rng.randint(0, 3)))
            uses[conv, f"c{i}"] = [f"c{j}" for j in after]
            calls.append((conv, f"c{i}", i, "f", "{" + '"t": "' + "long " * 30_000 + '"}' if i == 3 else "{}", uses[conv, f"c{i}"]))

    def level(conv, c, seen=()):
        if c in seen:
            return None
        inner = [level(conv, x, (*seen, c)) for x in uses[conv, c]]
        return None if None in inner else 1 + max(inner, default=-1)

    got = link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), schema_table(spark, {"f": {"t": ("string", False)}})).collect()
    assert {(r.conv_id, r.call_id): r.level for r in got} == {k: level(*k) for k in uses}
    assert any(r.level is None for r in got) and max(r.level or 0 for r in got) > 3


def test_nested_schemas(spark):
    inner = {"unit": {"type": "string", "enum": ["km", "mi"]}, "n": {"type": "integer", "required": True}}
    tools = {"f": {"to": {"type": "object", "fields": inner}, "tags": {"type": "array", "items": "string"}, "level": {"type": "integer", "enum": [1, 2]}}}
    given = ['{"to":{"n":1,"unit":"km"},"tags":["a"],"level":2}', '{"to":{"unit":"m"},"tags":[1],"level":3}', '{"tags":[]}', '{"to":3}', '{"to":{"n":"x"},"level":"1"}', "", None]
    calls = spark.createDataFrame([(1, str(i), i, "f", x, None) for i, x in enumerate(given)], CALLS)
    got = {r.turn: r.errors for r in link_calls(calls, spark.createDataFrame([], RESULTS), schema_table(spark, tools)).collect()}
    assert got == {0: [], 1: ["missing to.n", "type of tags", "value of level", "value of to.unit"], 2: [], 3: ["type of to"], 4: ["type of level", "type of to.n", "value of level"], 5: ["not an object"], 6: ["not an object"]}


def test_long_chain(spark):
    n = 70
    calls = spark.createDataFrame([(1, f"c{i}", i, "f", "{}", [f"c{i - 1}"] if i else None) for i in range(n)], CALLS)
    got = {r.turn: r.level for r in link_calls(calls, spark.createDataFrame([], RESULTS), schema_table(spark, {"f": {}})).collect()}
    assert got == {i: i for i in range(n)}


# ---- similarity join

def shingle_set(text):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(text or "")]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [shingle_set(x) for _, x in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    return Counter((d, len(sets[i]), min((x for x in ids[find(i)] if x is not None), default=None) if sets[i] else d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rows = corpus(seed)
    got = similar_components(table(spark, rows).select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
    assert Counter(map(tuple, got.collect())) == brute_components(rows)


def test_components_of_small_sets_and_chains(spark):
    rng = random.Random(4)
    rows, base = [], words(rng, 34, 50)
    for i in range(40):  # a chain: neighbours link, far ones don't
        base = list(base)
        base[rng.randrange(len(base))] = f"n{i}"
        rows.append((i, " ".join(base)))
    for i in range(60):
        rows.append((100 + i, " ".join(words(rng, rng.randint(1, 9), 3))))
    for i in range(30):  # one passage in texts of near the same length
        rows.append((300 + i, " ".join(words(rng, 60) + ["same"] * 3 + base + words(rng, 60))))
    got = similar_components(table(spark, rows).select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
    assert Counter(map(tuple, got.collect())) == brute_components(rows)
    assert similar_components(table(spark, []).select("doc_id", "text")).count() == 0


@pytest.mark.parametrize("size", [1, 4, 5, 9, 20, 60, 150, 400, 1500, 3000, 5500, 20000])
def test_linked_sets_share_the_needed_pieces(size):
    """The pigeonhole at the very edge of a link, within a band and across two; long sets need many shared pieces."""
    rng = np.random.default_rng(size)
    for larger in (0, 1, 2):  # differences on both sides, or all on one
        apart = 2 * size // 9 if larger == 0 else size // 4
        pool = np.unique(rng.integers(0, 1 << 63, 3 * size + 8, dtype=np.uint64))
        rng.shuffle(pool)
        a = pool[:size]
        b = np.concatenate((a[apart // 2 :], pool[size : size + apart - apart // 2])) if larger == 0 else pool[: size + apart]
        both = len(np.intersect1d(a, b))
        assert 100 * both >= 80 * (len(a) + len(b) - both)
        row, x = np.repeat([0, 1], [len(a), len(b)]), np.concatenate((np.sort(a), np.sort(b)))
        of, key = pieces(row, x, 2)
        need, most = offered(row, x, 2)
        assert (np.bincount(of, minlength=2) <= most).all()
        assert len(np.intersect1d(key[of == 0], key[of == 1])) >= need.max() >= 1
        if size >= 400:
            assert need.min() > 1


def test_jaccard_stage_keeps_one_of_each(spark):
    rows = corpus()
    out = jaccard_stage(spark, table(spark, rows), "")
    want = Counter(c if n else ("alone", d) for d, n, c in brute_components(rows))
    assert out.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    assert out.count() == len(want)


def test_connected_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {i: find(i) for i in linked} and len(got) == len(linked)


# ---- mixing

def test_mix(spark):
    rows = corpus() * 3
    out = mix(table(spark, rows)).collect()
    assert len(out) == len(rows) and all(r.taken <= 2 * r.size and r.taken >= 0 for r in out)
    by = defaultdict(list)
    for r in out:
        by[r.source].append(r)
    biggest = max(r.size for r in out)
    total = sum(r.size for r in out)
    for group in by.values():
        assert len({(r.source_size, r.target) for r in group}) == 1 and group[0].source_size == sum(r.size for r in group)
        assert group[0].target <= 2 * group[0].source_size and abs(sum(r.taken for r in group) - group[0].target) <= 3 * biggest
    assert sum(g[0].target for g in by.values()) == pytest.approx(min(1.5, 2) * total)
    # Taking or leaving whole documents of one size, a source is at most half of one off its target.
    same = mix(table(spark, [(i, "a b c d e f g") for i in range(101)])).collect()
    for s in {r.source for r in same}:
        group = [r for r in same if r.source == s]
        assert abs(sum(r.taken for r in group) - group[0].target) <= 3.5 + 1e-6
    key = lambda r: (r.doc_id is None, r.doc_id, r.text, r.taken)
    again = mix(table(spark, rows, parts=7)).collect()
    assert Counter(map(repr, map(key, out))) == Counter(map(repr, map(key, again)))
    assert mix(table(spark, [])).count() == 0


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 40}, {"x": 7}, {"a": 0, "b": 0}, {f"s{i:02}": (i * 37) % 90 for i in range(20)}])
def test_targets(spark, sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, open_, rest = dict.fromkeys(sizes, 0.0), set(sizes), 1.5 * sum(sizes.values())
    while open_ and rest > 1e-9:
        share = rest / sum(weight[s] for s in open_)
        for s in open_:
            target[s] += share * weight[s]
        rest = sum(max(0.0, target[s] - 2 * sizes[s]) for s in sizes)
        target = {s: min(target[s], 2.0 * sizes[s]) for s in sizes}
        open_ = {s for s in open_ if target[s] < 2 * sizes[s]}
    got = {r.source: r.target for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(target)


# ---- line dedup

def line_key(line):
    return line.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_lines(spark):
    rng = random.Random(8)
    shared = ["A Line That Many Documents Have é", "  another line that is long enough\t", "short line", "X" * 19, "x" * 20, "É" * 20]
    rows = [(i * 3 % 50, "\n".join(rng.choice([*shared, f"own line {i} {rng.random()}", "", " "]) for _ in range(rng.randint(0, 9)))) for i in range(50)]
    rows += [(60, None), (61, ""), (62, shared[0].upper().replace("É", "é") + "\r\n" + shared[0]), (70, "z" * 200_000)]
    docs = defaultdict(set)
    for d, text in rows:
        for line in (text or "").split("\n"):
            if len(line_key(line)) >= 20:
                docs[line_key(line)].add(d)
    want = set()
    for d, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(docs.get(line_key(x), ())) < 3 or d == max(docs[line_key(x)])]
        want.add((d, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    out = dedup_lines(table(spark, rows))
    got = out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256))
    assert {tuple(r) for r in got.collect()} == want
    assert out.columns == [*(x.split()[0] for x in SCHEMA.split(", ")), "n_lines", "n_dropped"]


def test_lines_odd_rows(spark):
    same = "a line that is long enough to count"
    rows = [(None, same), (None, same), (1, same), (1, same), (2, same + "\nmore")]
    got = Counter((r.doc_id, r.text) for r in dedup_lines(table(spark, rows)).collect())
    # Rows of one id are one document; without an id they come before all others.
    assert got == Counter({(None, ""): 2, (1, ""): 2, (2, same + "\nmore"): 1})
    assert dedup_lines(table(spark, [])).count() == 0


def test_runs_compact(spark):
    store = LineRuns(least_docs=2, fanout=2)
    for i in (9, 8, 7, 6, 5):
        store.add(spark.createDataFrame([(k, 0, i) for k in range(i % 3 + 1)], "k1 long, k2 long, id long"))
    assert [len(level) for level in store.levels] == [1, 0, 1]
    # Both merges read runs as they lie: neither shuffled nor sorted again.
    (a,), (b,) = store.levels[0], store.levels[2]
    before = spark.conf.get(_SORTED)
    spark.conf.set(_SORTED, "true")
    for how in ("left_anti", "full_outer"):
        plan = a.rows().join(b.rows().hint("merge"), ["k1", "k2"], how)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan, plan
    spark.conf.set(_SORTED, before)
    got = {(r.k1, r.last) for r in store.frequent().collect()}
    assert got == {(0, 9), (1, 8), (2, 8)}


# ---- repeated windows

@pytest.mark.parametrize(("window", "context", "most"), [(40, 24, 1000), (40, 40, 1000), (90, 30, 1000), (40, 12, 2), (300, 20, 3), (6, 3, 1000)])
def test_bytes(spark, window, context, most):
    rows = corpus()
    rows.append((12, rows[-1][1][:-30] + "x" + rows[-1][1][20_000:]))
    count = Counter()
    for _, text in rows:
        b = (text or "").encode()
        count.update(b[i : i + window] for i in range(len(b) - window + 1))
    want = Counter()
    for d, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if count[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        runs = len(re.findall(b"\1+", bytes(gone)))
        want[d, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g)] += 1
    out = remove_repeats(table(spark, rows), window, context, 50_000, most)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out.collect()) == want
    assert remove_repeats(table(spark, []), window, context).count() == 0


@pytest.mark.parametrize(("prefix", "most"), [(7, 1_000_000), (7, 2), (14, 1_000_000), (1, 1)])
def test_words(spark, prefix, most):
    rows, window = corpus(), 14
    rows += [(2000 + i, f"own{i} " + rows[0][1] + f" own{i}") for i in range(5)]
    count = Counter()
    for _, text in rows:
        w = WORD.findall(text or "")
        count.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    want = Counter()
    for d, text in rows:
        w = WORD.findall(text or "")
        gone = {k for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        want[d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    out = remove_repeated_words(table(spark, rows), window, prefix, 20_000, most)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out.collect()) == want
    assert remove_repeated_words(table(spark, []), window, 7).count() == 0


def test_one_huge_prefix(spark):
    """One passage in all documents, each time in other surroundings: its prefixes pass every bound, and Spark lengthens them."""
    rng = random.Random(5)
    passage = words(rng, 40)
    own = lambda i: [f"{w}-{i}" for w in words(rng, 30)]
    texts = [own(i) + passage + own(i) for i in range(300)]
    rows = [(i, " ".join(x)) for i, x in enumerate(texts)]
    for most in (5, 100_000):
        out = {r.doc_id: (r.n_removed, r.kept) for r in remove_repeated_words(table(spark, rows), 35, 8, 1000, most).collect()}
        assert out == {i: (40, " ".join(x[:30] + x[70:])) for i, x in enumerate(texts)}


def brute_nodes(texts, depth):
    """Of all suffixes of depth words or more: depth and weight of each branching prefix, and of those of full depth whether different words come before."""
    found, left = defaultdict(list), defaultdict(set)
    for r, t in enumerate(texts):
        for i in range(len(t) - depth + 1):
            for k in range(depth + 1):
                found[tuple(t[i : i + k])].append(t[i + k] if i + k < len(t) else None)
            left[tuple(t[i : i + depth])].add(t[i - 1] if i else ("start", r))
    return sorted((len(p), len(nexts), len(p) == depth and (len(left[p]) > 1 or any(isinstance(x, tuple) for x in left[p]))) for p, nexts in found.items() if len(nexts) > 1 and (len(p) == depth or len(set(nexts)) > 1))


def test_nodes_of_suffix_trees():
    rng = random.Random(3)
    for depth in (1, 3, 6):
        texts = [[rng.randint(1, 3) for _ in range(rng.randint(depth, 40))] for _ in range(12)]
        first = np.cumsum([0, *(len(t) for t in texts)])[:-1]
        size = np.array([len(t) - depth + 1 for t in texts])
        tokens = np.array([x for t in texts for x in t], np.uint64)
        zero, one = np.zeros(len(texts), np.int64), np.ones(len(texts), np.int64)
        got = subtrees(tokens, first, size, zero, one, depth)
        assert sorted(zip(got.depth.tolist(), got.weight.tolist(), got.many.tolist(), strict=True)) == brute_nodes(texts, depth)
        # A parent is above its node, weighs more, and roots only have none.
        inner = got.parent >= 0
        assert (got.depth[got.parent[inner]] < got.depth[inner]).all() and (got.weight[got.parent[inner]] > got.weight[inner]).all()
        assert (got.depth[got.of] == depth).all() and (np.bincount(got.of, minlength=len(got.depth))[got.depth == depth] == got.weight[got.depth == depth]).all()
        # Leaves under one node are the same words.
        run = np.repeat(np.arange(len(size)), size)
        start = first[run] + np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
        words_of = [tuple(tokens[s : s + depth].tolist()) for s in start[got.leaves].tolist()]
        assert len(set(zip(got.of.tolist(), words_of, strict=True))) == len(set(got.of.tolist())) == len(set(words_of))
        # Series of repeated windows begin at a node with different words before it.
        deep = dict(zip(got.leaves.tolist(), got.of.tolist(), strict=True))
        for leaf, node in deep.items():
            if leaf - 1 not in deep or run[leaf - 1] != run[leaf]:
                assert got.many[node]


def test_nodes_of_nothing():
    none = np.zeros(0, np.int64)
    got = subtrees(np.zeros(0, np.uint64), none, none, none, none, 3)
    assert not len(got.depth) and not len(got.leaves)


def brute_parts(at, size, off, step):
    """Windows of a run, parted by their distance from the minimiser."""
    parts_ = defaultdict(list)
    for k in range(size):
        parts_[(off - k) // step].append(at + k)
    return sorted((min(p), len(p)) for p in parts_.values())


def test_contexts_get_longer(spark):
    """All windows of a part share the tokens of its context, and parts of one window have all of them."""
    rng = random.Random(12)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(40, 200))) for _ in range(30)]
    units = Units(False, 40, 12)
    docs = with_uid(table(spark, list(enumerate(texts))))
    text_of = {(r["__u"], r["__v"]): r.text for r in docs.collect()}
    kinds = runs_of(docs, units).withColumns({"weight": F.lit(1), "off": F.lit(-1)})
    want = 0
    for step in (8, 1):
        before = {(r.u, r.v, r.at): r for r in kinds.collect()}
        kinds = keep(_parts_of(_wanted(docs, kinds), units, step), "parts")
        rows = kinds.collect()
        by = defaultdict(list)
        for r in rows:
            by[r.u, r.v, r.at - r.shift].append(r)
        assert set(by) == set(before)
        for key, some in by.items():
            assert sorted((r.at, r.size) for r in some) == brute_parts(key[2], before[key].size, some[0].off + some[0].shift, step)
        shared = defaultdict(set)
        for r in rows:
            assert r.off // step == (r.off - r.size + 1) // step
            text, m = text_of[r.u, r.v], r.at + r.off
            q = r.off // step * step
            shared[r.context].add((q, text[m - q : m - min(q + step - 1, 28) + 40]))
        assert all(len(x) == 1 for x in shared.values())
        want += len(shared)
        kinds = kinds.select("context", "span", "u", "v", "at", "size", "weight", "off")
    assert want and all(r.size == 1 for r in rows)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_strings_that_collide_modulo_powers_of_two(spark):
    """Thue-Morse words and their complements, which polynomials modulo 2**64 can't tell apart."""
    one = thue_morse(2048)
    other = one.translate(str.maketrans("ab", "ba"))
    off, data = utf8(pa.array([one, other]))
    at = np.array([0, 2048])
    assert len(set(spans(prefix(BYTE[data]), at, at + 2048).tolist())) == 2
    rows = [(i, one if i < 3 else other + " " * i) for i in range(4)]
    assert {r.doc_id: r.n_dropped for r in dedup_lines(table(spark, rows)).collect()} == {0: 1, 1: 1, 2: 0, 3: 0}
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.n_dup_lines for r in line_quality(table(spark, [(1, one + "\n" + other)]), labels).collect()] == [0]
    got = similar_components(table(spark, [(1, one), (2, other)]).select("doc_id", "text"))
    assert {r.component_id for r in got.collect()} == {1, 2}
    got = remove_repeated_words(table(spark, [(1, f"{one} x"), (2, f"{other} x")]), 2, 1)
    assert {r.n_removed for r in got.collect()} == {0}
    runs = {}
    for text in (one, other):
        for i in range(len(text) - 399):
            runs.setdefault(text[i : i + 400], []).append(i)
    gone = {t: {p + k for x, at in runs.items() if len(at) > 1 for p in at if t[p : p + 400] == x for k in range(400)} for t in (one, other)}
    got = {r.doc_id: r.n_removed for r in remove_repeats(table(spark, [(1, one), (2, other)])).collect()}
    assert got == {1: len(gone[one]), 2: len(gone[other])}


# ---- classifier

def test_knn(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(words(rng, 40))) for i in range(150)] + [(500 + i, " ".join(w.upper() + "!!" for w in words(rng, 40))) for i in range(150)] + [(900, None), (901, ""), (None, "some words here")]
    labels = spark.createDataFrame([(d, int(d < 500), 0) for d, _ in rows if d is not None and d < 900] + [(None, 1, 0), (3, None, None), (4, 1, 1)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality_scores(table(spark, rows), labels, 60).collect()}
    held = [d for d, _ in rows if d is not None and d < 900 and zlib.crc32(str(d).encode()) % 3 == 1]
    assert sum(out[d].predicted == int(d < 500) for d in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in out.values()) and out[900].score == out[901].score == 0 and out[900].predicted == 0
    assert isinstance(out[3].score, float) and out[3].kept == "b"
    none = quality_scores(table(spark, rows), labels.limit(0))
    assert {r.score for r in none.collect()} == {0.0, 0.5}
    assert quality_scores(table(spark, []), labels).count() == 0


def test_votes_against_a_plain_loop(spark):
    """Every labelled row compared with every document, one by one."""
    rng = random.Random(16)
    rows = [(i, " ".join(words(rng, rng.randint(5, 60))) + ("!! " * (i % 5))) for i in range(60)] + [(70, None), (71, " "), (72, " ".join(words(rng, 6000))), (None, "no id")]
    own = spark.createDataFrame([(d, int(len(t or "") % 2), 0) for d, t in rows if d is not None and d < 60], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in quality_scores(table(spark, rows), own, 1000).collect()}
    terms = lambda t: term_matrix(*utf8(pa.array([t], pa.string())))[0]
    learnt = sorted((d, t) for d, t in rows if d is not None and d < 60 and zlib.crc32(str(d).encode()) % 3 != 1)
    y = np.array([len(t) % 2 for _, t in learnt])
    model = fit_terms(np.stack([terms(t).astype(np.float16) for _, t in learnt]).astype(np.float32), y)
    for d, t in rows:
        want = 0.0
        if WORD.search(t or ""):
            v = terms(t) @ model["to"]
            sims = sorted(((float(v @ u) / max(float(np.linalg.norm(v)), 1e-12), k) for k, u in enumerate(model["rows"])), reverse=True)[:15]
            weights = [(max(s, 0.0) ** 8, y[k]) for s, k in sims]
            want = sum(w * q for w, q in weights) / max(sum(w for w, _ in weights), 1e-300)
        assert got[d] == pytest.approx(want, abs=1e-3)


# ---- decontamination

def edits(a, text):
    """Least edits from a to any run of text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_items(spark):
    rng = random.Random(12)
    items = [(i, " ".join(words(rng, rng.choice([3, 5, 9, 20, 45]), 60))) for i in range(25)] + [(90, None), (91, ""), (None, " ".join(words(rng, 12, 60)))]
    rows = [(1, None), (2, ""), (3, "x " * 20_000), (4, " ".join(words(rng, 3000, 60)))]
    for d in range(80):
        body = words(rng, 50, 60)
        if d % 2:
            item = (items[d % 25][1] or "").split()
            for _ in range(rng.choice([0, 1, 2, 3, 8])):
                op, at = rng.choice("sdi"), rng.randrange(len(item))
                item[at : at + (op != "i")] = [] if op == "d" else ["other"]
                item = item or ["other"]
            body[20:20] = [rng.choice([w, w.upper(), w + ","]) for w in item]
        rows.append((10 + d, rng.choice([" ", "\n"]).join(body)))
    out = find_items(table(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, m.item_id, m.distance) for r in out.collect() for m in r.matches}

    def toks(x):
        return re.findall(r"[a-z0-9é]+", (x or "").lower())

    want = set()
    for d, text in rows:
        for i, item in items:
            a = toks(item)
            if a and d != 3 and (e := edits(a, toks(text))) <= int(len(a) * 0.15):
                want.add((d, i, e))
    assert got == want and len(want) > 10
    blocks = find_items(table(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block_items=3)
    one = lambda df: Counter((r.doc_id, r.text, r.lang, r.kept, tuple(sorted(map(tuple, r.matches)))) for r in df.collect())
    assert one(blocks) == one(out) and blocks.columns == out.columns
    assert find_items(table(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert {len(r.matches) for r in find_items(table(spark, rows), spark.createDataFrame([], "item_id long, text string")).collect()} == {0}


def test_items_in_blocks(spark, monkeypatch):
    import assay.llm.decontaminate as module

    items = spark.createDataFrame([(i, f"item {i} has these seven words inside") for i in range(9)], "item_id long, text string")
    docs = table(spark, [(i, f"before item {i} has these seven words inside after") for i in range(9)])
    def found():
        return {(r.doc_id, tuple(sorted(m.item_id for m in r.matches if m.distance == 0))) for r in find_items(docs, items).collect()}

    whole = found()
    monkeypatch.setattr(module, "BLOCK", 2)
    assert found() == whole == {(i, (i,)) for i in range(9)}


# ---- strict and canonical JSON of tool calls

def test_arguments_are_taken_strictly(spark):
    tools = {
        "t": {"u": {"type": "string", "enum": ["a", "é", "q\"\\"]}, "n": {"type": "number", "enum": [1, 2.0, 1e30]}, "i": ("integer", False), "o": {"type": "object", "fields": {"b": ("string", True)}}, "free": ("object", False)},
        "bare": {},
    }
    cases = [
        ("t", '{"u":"a"} trailing', ["not an object"], None), ("t", '{"u":"a"},"x":{}', ["not an object"], None), ("t", '{"u":"a","u":"a"}', ["not an object"], None),
        ("t", '{"n":1e400}', ["number out of range", "value of n"], None), ("t", '{"n":2}', [], '{"n":2}'), ("t", '{"n":2.00}', [], '{"n":2}'), ("t", '{"n":0.2e1}', [], '{"n":2}'), ("t", '{"n":1e30}', [], '{"n":1.0E30}'),
        ("t", '{"i":1e2}', ["type of i"], '{"i":100}'), ("t", '{"i":100}', [], '{"i":100}'), ("t", '{"u":"é"}', [], '{"u":"é"}'), ("t", '{"u":"\\u00e9"}', [], '{"u":"é"}'), ("t", '{"u":"q\\"\\\\"}', [], '{"u":"q\\"\\\\"}'),
        ("t", '{"o.b":"x"}', ["unknown o.b"], '{"o.b":"x"}'), ("t", '{"o":{}}', ["missing o.b"], '{"o":{}}'), ("t", '{"o":{"b":"x","c":1,"d":2}}', ["unknown o.c", "unknown o.d"], '{"o":{"b":"x","c":1,"d":2}}'),
        ("t", '{"free":{"x":[1.50,"1.0",{"y":-0.0}],"z":1E3}}', [], '{"free":{"x":[1.5,"1.0",{"y":0}],"z":1000}}'), ("bare", '{"k":1}', ["unknown k"], '{"k":1}'), ("bare", "{}", [], "{}"), ("bare", "Infinity", ["not an object"], None),
    ]
    calls = spark.createDataFrame([("c", f"i{k}", k, name, text, None) for k, (name, text, _, _) in enumerate(cases)], "conv_id string, call_id string, turn long, name string, arguments string, after array<string>")
    none = spark.createDataFrame([], "conv_id string, call_id string, turn long, content string")
    got = {r.call_id: r for r in link_calls(calls, none, schema_table(spark, tools)).collect()}
    import json

    for k, (_, text, errors, written) in enumerate(cases):
        r = got[f"i{k}"]
        assert r.errors == errors, (text, r.errors)
        if written is not None:
            assert f'"arguments":{written},' in r.record, (text, r.record)
        else:
            assert json.loads(r.record)["arguments"] is None

"""Quality rules, the manifest and the trie of conversations against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from support import rows_of

from packetweave.llm import merkle, oracle, quality, queries, trie

# Quality rules.


def counted(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


def test_counts_of_texts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = ["a b c a b c a b c", "x\n\nx \nx\n", "", None, "# $%&\x0b|\x0c<>\r*", "é😀 é😀 é😀 é😀", "w " * 5000 + "end", "  "]
    rows = [(i, t) for i, t in enumerate(odd)] + [(r.doc_id + 100, r.text) for r in docs.collect()]
    found = quality.with_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found} == {i: counted(t) for i, t in rows}


def test_buckets_hold_what_lies_between_their_ends(spark):
    values = sorted({*range(300), *(2**k + d for k in range(9, 40) for d in (-1, 0, 1))})
    number = quality.bucket(F.col("v"))
    low, high = quality.ends(F.col("b"))
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", number.alias("b")).select("v", "b", low.alias("low"), high.alias("high")).collect()
    assert all(r.low <= r.v <= r.high and (r.high - r.low) * 32 <= r.low for r in rows)
    assert [r.b for r in sorted(rows, key=lambda r: r.v)] == sorted(r.b for r in rows)


def varied(rng, odd=False):
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(120)]
    return " ".join(w + "##" if odd else w for w in words)


def test_thresholds_follow_the_source(spark):
    """What is usual in one source is unusual in another of the same language; nothing usual goes."""
    rng = random.Random(5)
    rows = [(i, varied(rng), "en", "prose", 1) for i in range(200)] + [(i, varied(rng, True), "en", "code", 1) for i in range(200, 260)]
    rows += [(900 + i, varied(rng, True), "en", "prose", 0) for i in range(5)] + [(910, varied(rng, True), None, None, 1), (911, "too short", "en", "prose", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int")
    judged, sketch = quality.quality(docs)
    # 60 of 265 in the language have symbols, so its third quartile has none: the fence of "prose" stays, that of "code" is its own.
    assert {r.doc_id: r.kept for r in judged.collect()} == {r[0]: bool(r[4]) for r in rows}
    assert rows_of(quality.filtered(docs)) == rows_of(docs.filter("kept = 1"))
    parts = [quality.sketches(quality.measured(docs.filter(f"doc_id % 3 = {k}"))) for k in range(3)]
    assert rows_of(quality.merged(*parts)) == rows_of(sketch)
    later, _ = quality.quality(docs.filter("source = 'code'"), earlier=sketch)
    assert {r.kept for r in later.collect()} == {True}


# The manifest.


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 80, 81, 82, 242, 243])
def test_addresses_in_a_log(n):
    leaves = [str(i) for i in range(n)]
    log, level, depth = merkle.completed(leaves), leaves, 0
    while True:
        assert [log[merkle.position(depth, i, n)] for i in range(len(level))] == level
        if len(level) == 1:
            break
        level, depth = [merkle.parent(level[i : i + 3]) for i in range(0, len(level), 3)], depth + 1
    assert len(log) == merkle.subtree_size(depth, 0, n)
    assert {merkle.folded(leaf, path) for leaf, path in zip(leaves, merkle.siblings(log, n))} == {level[0]}


def plain_tree(leaves):
    """Root, and each leaf's siblings level by level."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([merkle.parent(levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    paths = []
    for i in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            run = level[i // 3 * 3 : i // 3 * 3 + 3]
            path += run[: i % 3] + run[i % 3 + 1 :]
            i //= 3
        paths.append(path)
    return levels[-1][0], paths


def test_large_trees_take_several_rounds(spark):
    """One source of three rounds of blocks, one of two, and small ones, against one plain tree each."""
    sizes = {"big": 243 * 243 + 2, "half": 500, "one": 1, None: 3}
    docs = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, n int").selectExpr("source", "explode(sequence(1, n)) as i").selectExpr(
        "cast(i as long) as doc_id", "source", "if(i % 7 = 0, null, 'en') as lang", "cast(2 as long) as n_chars", "concat('t\n', i) as text")
    held = defaultdict(list)
    for s, n in sizes.items():
        for i in range(1, n + 1):
            field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
            held[s].append(hashlib.sha256("".join(map(field, (i, s, None if i % 7 == 0 else "en", 2, f"t\n{i}"))).encode()).hexdigest())
    order = [None, "big", "half", "one"]
    trees = {s: plain_tree(held[s]) for s in order}
    root, above = plain_tree([trees[s][0] for s in order])
    wanted = {}
    for place, s in enumerate(order):
        for i, (leaf, path) in enumerate(zip(held[s], trees[s][1])):
            wanted[s, i + 1] = (leaf, trees[s][0], root, hashlib.sha256("".join(path + above[place]).encode()).hexdigest(), root, True)
    found = {r.leaf: tuple(r)[1:] for r in merkle.audited(docs).collect()}
    assert found == {v[0]: v for v in wanted.values()}


def test_a_changed_text_does_not_lead_to_the_root(spark):
    docs = spark.createDataFrame([(i, "s", "en", 3, t) for i, t in enumerate(["a\nb", "ab", None, "", "a\nb"])], "doc_id long, source string, lang string, n_chars long, text string")
    changed = merkle.audited(docs, lambda d: F.when(F.col("doc_id") == 4, F.lit("ab")).otherwise(F.col("text")))
    assert {r.doc_id: r.verified for r in changed.collect()} == {0: True, 1: True, 2: True, 3: True, 4: False}


# The trie.


def test_median_first_lists_every_place_once():
    for n in range(40):
        assert sorted(trie.median_first(n)) == list(range(n))


def test_siblings_are_balanced_and_in_order():
    tree = trie.SearchTree()
    for i in trie.median_first(1000):
        tree.add([i], [1], 1, i)
    deepest, waiting = 0, [(tree.child[0], 1)]
    while waiting:
        node, depth = waiting.pop()
        deepest = max(deepest, depth)
        waiting += [(x, depth + 1) for x in (tree.low[node], tree.high[node]) if x >= 0]
    assert deepest <= 10 and [tree.sign[c] for c in tree.children(0)] == list(range(1000))


@pytest.mark.parametrize("shard_turns", [1, 7, 60])
def test_shards_of_any_size_give_one_trie(spark, awkward_dir, by_sql, shard_turns):
    """Cuts inside shared prefixes, between a sequence and its continuation, and in copies."""
    sequences = trie.rebuilt(spark.read.parquet(f"{awkward_dir}/conversations.parquet"))
    nodes, members = trie.prefix_trie(sequences, shard_turns)
    found = trie.with_end_digests(nodes, members).select(
        F.col("first").alias("conv_id"), "depth", F.col("parent_first").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), "ends_sha256")
    assert rows_of(found) == by_sql(awkward_dir, oracle.OP13)


def test_ids_of_a_class_are_hashed_in_order(spark):
    members = spark.range(5000).selectExpr("if(id % 3 = 0, 7L, 1L) as end_class", "id * 13 - 1000 as conv_id")
    ids = defaultdict(list)
    for r in members.collect():
        ids[r.end_class].append(r.conv_id)
    wanted = {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in ids.items()}
    assert {r.end_class: r.ends_sha256 for r in trie.ends_digests(members, packed_ids=11).collect()} == wanted


@pytest.mark.parametrize("name", ["op11_quality", "op12_merkle", "op13_prefixes"])
def test_larger_tables(spark, small, by_sql, name):
    folder = small.replace("sf0.001", "sf0.01")
    assert rows_of(queries.registered()[name](spark, folder)) == by_sql(folder, oracle.statements()[name])

import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from corpuscope.llm.mixing import mix, quality_weights, source_targets, word_sizes
from corpuscope.llm.sharding import byte_shards

AWKWARD = [(3, "aé"), (1, None), (None, "null id"), (2, ""), (2, ""), (7, "x" * 5000), (5, "tie"), (5, "tie")]


def brute_shards(rows, shards):
    sizes = sorted(
        ((d is not None, d or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), d) for d, t in rows)
    )
    total = sum(s[2] for s in sizes)
    before, slots, out = 0, defaultdict(int), []
    for _, _, size, crc, doc in sizes:
        shard = min((2 * before + size) * shards // (2 * total), shards - 1)
        out.append((doc, size, crc, shard, slots[shard]))
        slots[shard] += 1
        before += size
    return out


def test_shards_against_brute_force(documents):
    for rows in (AWKWARD, [(i * 37 % 1001, "w" * (i * i % 300)) for i in range(400)], [(1, "one")], []):
        got = [tuple(r) for r in byte_shards(documents(rows), 4).collect()]
        assert sorted(map(str, got)) == sorted(map(str, brute_shards(rows, 4)))


def test_shards_plan_is_native(documents):
    plan = byte_shards(documents(AWKWARD), 4)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_targets_are_shared_again(llm):
    sizes = llm.createDataFrame([("a", 10), ("b", 1000), ("c", 0), (None, 100)], "source string, size long")
    targets = {r.source: r.target for r in source_targets(sizes).collect()}
    # a weighs 5, b 2, c 1, null 5; a stops at 30, null at 300, c has nothing
    assert targets == {"a": 30.0, "c": 0.0, None: 300.0, "b": 780.0}


def test_mix_takes_near_the_target(documents, sentence):
    rows = [(i, sentence(i, i % 40 + 1), "en", f"s{i % 3}") for i in range(300)]
    rows += [(900, None, None, None), (901, "", None, "s0"), (902, "one two", None, None), (5, rows[5][1], "en", "s2")]
    df = documents(rows).withColumn("weight", F.lit(None).cast("double")).drop("size")
    sized = word_sizes(df, extra=("weight",))
    mixed = mix(sized).collect()
    assert len(mixed) == len(rows)
    taken = defaultdict(int)
    for r in mixed:
        assert r.taken == r.copies * r.size and r.copies <= 3
        taken[r.source, r.target] += r.taken
    for (_, target), words in taken.items():
        assert abs(words - target) <= 20
    again = mix(sized.repartition(5)).collect()
    assert sorted(map(str, mixed)) == sorted(map(str, again))
    assert mix(sized.limit(0)).count() == 0


def test_rows_without_an_id_are_drawn_by_their_texts(documents, sentence):
    rows = [(None, sentence(i, i % 9 + 1), "en", "a") for i in range(90)] + [(i, sentence(i, 40), "en", "b") for i in range(30)]
    sized = word_sizes(documents(rows).withColumn("weight", F.lit(1.0)).drop("size"), extra=("weight",))
    mixed = [r for r in mix(sized, weights=(1, 8)).collect() if r.doc_id is None]
    least = min(r.copies for r in mixed)
    sizes = {copies: {r.size for r in mixed if r.copies == copies} for copies in (least, least + 1)}
    # long ones are among those taken once more, short ones among the others
    assert len(mixed) == 90 and max(sizes[least + 1]) > min(sizes[least]) and len(sizes[least] & sizes[least + 1]) > 2


def test_quality_weights_follow_labels(llm, documents):
    labels = llm.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1)], "doc_id long, quality int")
    df = documents([(1, "a"), (2, "b"), (3, "c"), (None, "d")]).select("doc_id")
    got = {r.doc_id: r.weight for r in quality_weights(df, labels).collect()}
    assert got == {1: 4.0, 2: 1.0, 3: 2.0, None: 2.0}

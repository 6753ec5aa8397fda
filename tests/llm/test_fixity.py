import hashlib
import random

from inkwell.llm import fixity
from pyspark.sql import functions as F


def brute(left, right):
    sides = []
    for rows in (left, right):
        own = {}
        for archive, offset, record in rows:
            if None not in (archive, offset, record):
                own.setdefault((archive, offset), set()).add(hashlib.sha256(record).hexdigest())
        sides.append({k: "+".join(sorted(v)) for k, v in own.items()})
    a, b = sides
    return {(*k, "missing" if k not in b else "extra" if k not in a else "changed") for k in a.keys() | b.keys() if a.get(k) != b.get(k)}


def test_finds_exactly_the_damage(spark):
    rng = random.Random(1)
    left = []
    for name in [f"a{i}" for i in range(40)] + [None]:
        at = 0
        for _ in range(rng.choice([1, 5, 200])):
            record = rng.randbytes(rng.choice([1, 50, 300]))
            left.append((name, at, record))
            at += len(record) * 97
    right = [(n, o, rng.choice([r, r + b"x", r[:-1] + b"?"]) if rng.random() < 0.03 else r) for n, o, r in left if rng.random() > 0.01]
    right += [("a1", 10**9, b"late"), ("new", 0, b"file"), ("a2", None, b"?"), ("a2", 5, None), right[3], right[3]]
    frames = [spark.createDataFrame(x, "archive string, offset long, record binary") for x in (left, right)]
    sides = [fixity.inventory(f, F.col("archive"), F.col("offset"), F.col("record")) for f in frames]
    got = [(r.archive, r.offset, r.kind) for r in fixity.audit(*sides).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(left, right) and len(got) > 20
    assert fixity.audit(sides[0], sides[0]).count() == 0
    assert fixity.audit(sides[0].limit(0), sides[0].limit(0)).count() == 0


def test_descends_only_where_roots_differ(spark):
    rows = spark.range(3000).select(F.lit("a").alias("archive"), (F.col("id") * 1000).alias("offset"), F.lit(1000).cast("long").alias("length"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    other = rows.withColumn("digest", F.when(F.col("offset") == 1_234_000, F.lit("x")).otherwise(F.col("digest")))
    ours, theirs = fixity.tree(rows, 2, 0), fixity.tree(other, 2, 0)
    assert [t.count() for t in ours] == [46, 3, 1, 1]
    assert [fixity.differing(a, b, ["archive", "node"]).count() for a, b in zip(ours, theirs, strict=True)] == [1, 1, 1, 1]


def test_clashing_columns_and_many_archives(spark):
    df = spark.createDataFrame([("x", 0, b"one", "a", 1), ("x", 9, b"two", "b", 2)], "archive string, offset long, record binary, node string, `a.b` int")
    side = fixity.inventory(df, F.col("archive"), F.col("offset"), F.col("record"))
    assert side.columns == ["archive", "offset", "length", "digest"] and fixity.audit(side, side.limit(1)).count() == 1
    pages = spark.createDataFrame([(10**11, "u", "h"), (10**12 + 1, "u", "h")], "page_id long, url string, html string")
    names = {r.archive for r in fixity.archived(pages, F.col("html"), F.col("html")).collect()}
    assert names == {"crawl-781250000.warc", "crawl-7812500000.warc"}

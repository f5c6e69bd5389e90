from causerie.llm import sharding

ROWS = [(5, "é" * 10), (3, "abc"), (None, "xy"), (4, None), (1, ""), (3, "abc"), (2, "z" * 1000), (9, "")]


def docs(spark, rows):
    return spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id bigint, text string, shard int, part int").repartition(3)


def brute(rows, n):
    sized = sorted(((i is not None, i or 0, len((t or "").encode())), i) for i, t in rows)
    total = sum(s[0][2] for s in sized)
    target, at, out = max(1, -(-total // n)), 0, []
    for (_, _, size), i in sized:
        out.append((i, size, at, min(at // target, n - 1)))
        at += size
    return out


def test_as_brute_force(spark):
    many = [(i * 7 % 501, "w" * (i % 13)) for i in range(501)]
    for rows, n in ((ROWS, 4), (many, 16), ([], 3), ([(1, None)], 2)):
        got = [tuple(r) for r in sharding.shard(docs(spark, rows), n).collect()]
        assert sorted(got, key=str) == sorted(brute(rows, n), key=str)

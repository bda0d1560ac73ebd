"""NN-descent groups of vectors against brute force, with edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import neargraph, queries

KIND = "vec_id long, embedding array<float>, label int, node long, n int, g string, root double"
ROOT = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab, 1, 2, "g", 0.5) for i, v, lab in rows], KIND)


def brute(rows, least=0.93):
    def fine(v, lab, i):
        return i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if fine(v, lab, i) else None for i, v, lab in rows]
    near = [[] for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                near[a].append(b)
                near[b].append(a)
    root = list(range(len(rows)))
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        root[a] = min((rows[x][0] for x in seen if rows[x][0] is not None), default=None)
    return sorted(((rows[a][0], len(near[a]), root[a], rows[a][0] is not None and rows[a][0] == root[a]) for a in range(len(rows))), key=str)


def planted(seed, clump=60):
    """Random vectors, small groups of near copies, one group larger than any list, a chain, and equal vectors."""
    rnd = np.random.default_rng(seed)
    base = rnd.standard_normal((400, 24))
    rows = [(v, int(rnd.integers(3))) for v in base]
    rows += [(base[i] + 0.1 * rnd.standard_normal(24), rows[i][1]) for i in range(0, 60)]
    rows += [(base[100] + 0.06 * rnd.standard_normal(24), 1) for _ in range(clump)]
    rows += [(base[7], rows[7][1])] * 5 + [(base[8], (rows[8][1] + 1) % 3)]
    step = rnd.standard_normal((2, 24))
    rows += [(step[0] + 0.15 * t * step[1], 2) for t in range(12)]
    return [(3 * i + 1, v.tolist(), lab) for i, (v, lab) in enumerate(rows)]


@pytest.mark.parametrize("seed,block", [(1, 1024), (2, 16)])
def test_groups_match_brute_force(spark, seed, block):
    rows = planted(seed)
    got = {r[0]: tuple(r) for r in neargraph.vector_groups(frame(spark, rows), block=block).collect()}
    want = {r[0]: r for r in brute(rows)}
    assert got.keys() == want.keys()
    found, true = sum(min(got[i][1], want[i][1]) for i in want), sum(r[1] for r in want.values())
    assert all(got[i][1] <= want[i][1] for i in want) and found >= 0.95 * true  # never invented
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)
    assert sum(got[i][2:] == want[i][2:] for i in range(1, 1200, 3)) >= 0.97 * 400


def test_groups_of_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1, 0, 0], 5), (2, [1, 0.01, 0], 5), (3, [1, 0, 0], None), (None, [1, 0, 0], 5), (4, None, 5), (5, [], 5), (6, [0, 0, 0], 5), (7, [1, None, 0], 5),
            (8, [nan, 1, 0], 5), (9, [inf, 1, 0], 5), (10, [2, 0, 0], 5), (11, [1, 0], 5), (12, [1, 0, 0], 6), (13, [1, 0, 0], 5), (13, [1, 0, 0], 5), (14, [-1, 0, 0], 5)]
    got = neargraph.vector_groups(frame(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert neargraph.vector_groups(frame(spark, [])).count() == 0
    assert [tuple(r) for r in neargraph.vector_groups(frame(spark, [(3, [0.5], 1)])).collect()] == [(3, 0, 3, True)]


def test_audit_counts_missed_links(spark):
    rows = [(i, [1.0, 0.001 * i, 0.0], 1) for i in range(40)]
    _, nodes = neargraph._prepared(frame(spark, rows), "vec_id", "embedding", "label")
    half = nodes.select("node", F.lit(39 // 2).cast("long").alias("n"))
    n, share = neargraph.audit(nodes, half, 0.93)
    assert n > 20 and abs(share - 19 / 39) < 1e-9
    assert neargraph.audit(nodes, nodes.select("node", F.lit(39).cast("long").alias("n")), 0.93)[1] == 1.0


def test_query_returns_every_row(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in queries.table(spark, ROOT, "embeddings").collect()]
    assert sorted((tuple(r) for r in queries.op13(spark, ROOT).collect()), key=str) == brute(rows)

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lorekiln.plans import reference_queries_2 as r2
from lorekiln.plans import registry


@pytest.mark.parametrize("tile", [7, 1000])
def test_all_pairs_of_a_label(spark, tmp_path, monkeypatch, tile):
    monkeypatch.setattr(r2, "TILE", tile)
    rng = np.random.default_rng(3)
    ids, labels, x = list(range(50)), [k % 3 for k in range(49)] + [9], rng.normal(size=(50, 8)).astype(np.float32)
    x[48] = 0
    at = {"vec_id": pa.array(ids, pa.int64()), "label": pa.array(labels, pa.int32()), "embedding": pa.array(x.tolist(), pa.list_(pa.float32()))}
    pq.write_table(pa.table(at), tmp_path / "embeddings.parquet")
    y = x.astype(float)
    norm = np.linalg.norm(y, axis=1)
    cos = lambda a, b: float(y[a] @ y[b] / (norm[a] * norm[b])) if norm[a] and norm[b] else None
    want = {(a, b): cos(a, b) for a in ids for b in ids if a < b and labels[a] == labels[b]}
    got = [tuple(r) for r in registry.QUERIES["pairwise_cosine_batch"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want)
    assert {(a, b): c for a, b, c in got} == {k: v if v is None else pytest.approx(v, abs=1e-5) for k, v in want.items()}
    near = {a: sorted((v for k, v in want.items() if a in k and v is not None), reverse=True) for a in ids}
    best = {r.id_a: r.best for r in registry.QUERIES["nearest_vector"](spark, str(tmp_path)).collect()}
    assert best == {a: pytest.approx(max([0.0, *c[:1]]), abs=1e-5) for a, c in near.items()}
    margin = {r.id_a: r.margin for r in registry.QUERIES["nearest_vector_margin"](spark, str(tmp_path)).collect()}
    assert margin == {a: pytest.approx(c[0] - c[1], abs=1e-5) if len(c) > 1 else None for a, c in near.items()}
    risk = {r.label: r.collision for r in registry.QUERIES["label_collision"](spark, str(tmp_path)).collect()}
    assert risk == {k: pytest.approx(max(near[a][0] for a in ids if labels[a] == k and near[a]), abs=1e-5) if k != 9 else None for k in (0, 1, 2, 9)}

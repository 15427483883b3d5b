import pyarrow as pa
import pyarrow.parquet as pq

from lorekiln.plans import registry


def test_broken_payloads_keep_their_rows(spark, tmp_path):
    payloads = ['{"temp_qid": "a"}', '{"temp_qid": "b", "x": [', '{"temp_qid" : 12, "x', '{"temp_qid": 12', "{", None, "", '{"x": 1}']
    at = {"file_id": pa.array([1] * 8, pa.int64()), "line_no": pa.array(range(8), pa.int32()), "payload": payloads}
    pq.write_table(pa.table(at), tmp_path / "judge_raw.parquet")
    got = {r.line_no: r.temp_qid for r in registry.QUERIES["extract_json_fallback"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(["a", "b", "12", None, None, None, None, None]))

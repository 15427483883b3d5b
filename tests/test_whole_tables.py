import pyarrow as pa
import pyarrow.parquet as pq

from lorekiln.plans import registry

ANSWERS = ["  Ab. ", None, "", " \t", "\u00a0Caf\u00c9\u00a0", "\uff21\uff22\uff11", "a\nb", "It's 5!\t", "\ufb01n"]


def test_every_answer_is_normalised(spark, tmp_path):
    pq.write_table(pa.table({"record_id": pa.array(range(9), pa.int64()), "answer": ANSWERS}), tmp_path / "validation_batch.parquet")
    got = {r.record_id: r.answer for r in registry.QUERIES["normalize_value"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(["ab.", None, None, "", "caf\u00e9", "ab1", "a\nb", "it's 5!", "fin"]))
    got = {r.record_id: r.text for r in registry.QUERIES["clean_input_string"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(["ab", "", "", "", "caf\u00e9", "\uff21\uff22\uff11".lower(), "a\nb", "its 5", "\ufb01n"]))

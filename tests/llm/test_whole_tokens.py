from graphloom.llm import byte_bpe, queries

SF = "/root/testdata/sf0.001"


def test_the_query_makes_offsets(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(byte_bpe, "digest", lambda encoded, ranks: seen.append(encoded) or encoded)
    queries.op4_byte_bpe(spark, SF)
    assert seen[0].columns == ["doc_id", "ids", "offsets"]
    assert all(len(r.ids) == len(r.offsets) for r in seen[0].limit(50).collect())

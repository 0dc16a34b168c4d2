import pytest
from test_files import SSN, given

from culvert import cli
from culvert.functions.registry import register
from culvert.functions.tables import analyze_texts

BAD = [
    "WHAT 1", "NODE A inlet 0 0 x 1 1 1", "NODE A inlet 0 0 1 1 1 1 late", "NODE A", "node A lake 1 2 3 4", "PIPE P A", "PIPE P A B 1 2", "IDF 1 2", "JUNCTIONK ten", "IDF 1 2 3\n\nMINTC",
    "NODE A inlet 0 0 1 2 1 1\nPIPE P A B 10 1 0.013",
]
GOOD = [SSN, SSN.replace("tailwater 100.5", "INTENSITY 30\nJUNCTIONK 0.7\nMINSLOPE 0.002"), SSN.replace("180 1.75", "180 0.5").replace("104 110", "100.5 101"), SSN.lower().replace("node", "Node")]


def test_table_function_as_the_reports(spark):
    """The same rows as cli.analyze_ssn, which works on tables; errors too."""
    assert "analyze_ssn" in register(spark)
    found = given(spark, *GOOD, *BAD)
    expected = {r.network_id: (r.rp_years, r.text) for r in cli.analyze_ssn(found).collect()}
    found.createOrReplaceTempView("ssn_texts")
    got = spark.sql("SELECT * FROM analyze_ssn(TABLE(ssn_texts) PARTITION BY network_id)")
    assert got.columns == ["network_id", "rp_years", "text"]
    rows = {r.network_id: (r.rp_years, r.text) for r in got.collect()}
    assert rows == expected and sum(t.startswith("error: line") for _, t in rows.values()) == 10
    for dealt in ("", "PARTITION BY network_id % 3"):
        assert {r.network_id: (r.rp_years, r.text) for r in spark.sql(f"SELECT * FROM analyze_ssn(TABLE(ssn_texts) {dealt})").collect()} == expected
    assert spark.sql("SELECT text FROM analyze_ssn(TABLE(SELECT text FROM ssn_texts WHERE network_id = 1))").first().text == expected[1][1]


def test_table_function_arguments(spark):
    register(spark)
    with pytest.raises(Exception, match="string column text"):
        spark.sql("SELECT * FROM analyze_ssn(TABLE(SELECT 1 AS network_id))").collect()
    with pytest.raises(Exception, match="takes TABLE|TABLE"):
        spark.sql("SELECT * FROM analyze_ssn(1)").collect()
    assert [(rp, text[:3]) for rp, text in analyze_texts([None, "", "WHAT"])] == [(10, "==="), (10, "==="), (None, "err")] and list(analyze_texts([])) == []
    assert spark.sql("SELECT * FROM analyze_ssn(TABLE(SELECT 1L AS network_id, '' AS text WHERE false) PARTITION BY network_id)").count() == 0

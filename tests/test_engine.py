import duckdb
import pytest
from siltstone.plans import queries as Q

SF = "/root/testdata/sf0.001"
BRANCHES = ["q_syslog_pri", "q_syslog_sd", "q_cef_header", "q_csv_header", "q_leef_delimiter", "q_json_array", "q_text_tokens", "q_layout_timestamp", "q_xml_tags", "q_first_log", "q_pretty_log", "q_rule_options", "q_waiting_again"]
TABLES = ["events", "documents", "customer"]


@pytest.mark.parametrize("name", ["q_detect_format", "q_fingerprint_hash", "q_default_rule", "q_parse_rules", "q_parse_metadata", "q_parse_errors", "q_status_machine", "q_user_stats", "q_page_newest", "q_preview", "q_syslog_headers", "q_stream_pipeline", *BRANCHES])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    df = Q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = con.execute(Q.SQL[name])
    names = [d[0] for d in found.description]
    want = sorted(tuple(str(r[names.index(c)]) for c in cols) for r in found.fetchall())
    assert sorted(names) == cols and sorted(tuple(str(r[c]) for c in cols) for r in df.collect()) == want

"""Keys in the form of environment files."""

from tallyforge.llm import secrets

KEY = "aB3" + "xY9/" * 9 + "q"


def test_key_after_an_equals_sign_is_a_candidate(spark):
    both = f"AWS_ACCESS_KEY_ID=AKIA{'Z' * 16}\nexport AWS_SECRET_ACCESS_KEY={KEY}\n"
    rows = [(1, both), (2, f"AWS_SECRET_ACCESS_KEY={KEY}"), (3, f"AKIA{'Z' * 16} {KEY}=")]
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.found or []] for r in secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = both.index(KEY)
    assert ("key", at, at + len(KEY)) in found[1]
    assert found[2] == [] and [x[0] for x in found[3]] == ["access"]

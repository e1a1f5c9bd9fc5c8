import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lektra.llm import secrets
from tests.conftest import SF


def slow(text):
    found = []
    for k, rule in enumerate(secrets.RULES):
        for m in re.finditer(rule.pattern, text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                found.append((m.start(), k, m.end(), rule.kind))
    return [(kind, s, e) for s, _, e, kind in sorted(found)]


def test_queries():
    q = {r.kind: secrets.trigram_query(r.pattern) for r in secrets.RULES}
    assert q["access"] == ("and", ("aki", "kia"))
    assert q["hex"] is True
    assert {"pas", "ecr", "oke", "api", "key"} <= secrets.trigrams(q["assign"])
    assert secrets.trigram_query("a.c") is True and secrets.trigram_query("(abc|de)f*") is True
    assert secrets.trigram_query("ab(c|d)x?") == ("or", ("abc", "abd")) or secrets.trigrams(secrets.trigram_query("ab(c|d)x?")) >= {"abc", "abd"}
    assert secrets.trigram_query("(abc)+x") == ("and", ("abc",)) or secrets.trigram_query("(abc)+x") == "abc"


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in secrets.digest(secrets.scanned(docs)).collect()}
    some = 0
    for r in docs.collect():
        spans = slow(r.text)
        some += bool(spans)
        assert rows[r.doc_id].spans == ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert rows[r.doc_id].base_sha256 == secrets.base_digest(spans)
        assert (rows[r.doc_id].n_assign, rows[r.doc_id].n_access, rows[r.doc_id].n_hex) == tuple(sum(s[0] == k for s in spans) for k in ("assign", "access", "hex"))
    assert some


PARTS = st.sampled_from(["password", "PassWD", "Secret", "token", "ſecret", "toKen", "apikey", "api_key", "API_KEY", " ", "  ", "=", ":", '"', "'", "abcdef0123456789", "AKIA", "AKIAABCDEFGHIJ1234", "é", "0123456789abcdef", "x", "ghp_" + "a1" * 18, "https://u:p@h", "postgres://u:", "p@s/", "@", "-----BEGIN RSA PRIVATE KEY-----", "-----END PRIVATE KEY-----", "Bearer ", "sk-", "\n"])


@settings(deadline=None, max_examples=300)
@given(st.lists(st.lists(PARTS, max_size=12).map("".join), max_size=6))
def test_index_loses_nothing(texts):
    assert secrets.scanner(secrets.RULES).scan(texts) == [slow(t) for t in texts]


def test_nulls_ties_and_clashing_columns(spark):
    rows = [(1, "token=abcdefghijklmn", "s", 20), (1, "token=abcdefghijklmn", None, 20), (None, None, "s", None), (2, "", "s", 0), (3, "é " * 300_000 + "AKIA" + "B" * 14, "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_chars int")
    assert sorted(r.spans for r in secrets.digest(secrets.scanned(docs)).collect()) == ["", "", "access:600000:600018", "assign:0:20", "assign:0:20"]
    out = {(r.doc_id, r.spans): r for r in secrets.redacted(docs).collect()}
    assert out[1, "s"].text == "[assign]" and out[1, None].n_chars == 8 and out[None, "s"].text is None and out[2, "s"].text == ""
    assert out[3, "s"].text.endswith("é [access]") and secrets.redacted(docs).schema == docs.schema
    empty = spark.createDataFrame([], docs.schema)
    assert secrets.scanned(empty).count() == 0 and secrets.redacted(empty).count() == 0


def test_nothing_of_a_secret_stays():
    """Masked whole: the body of a key, passwords with any sign; what is no secret stays."""
    body = "\n".join("MIIEpAIBAAKCAQEA" + "x" * 40 for _ in range(5))
    scan = secrets.scanner(secrets.RULES)
    mask = lambda t: secrets.masked(t, scan.scan([t])[0])
    key = f"-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----"
    assert mask(f"a\n{key}\nb") == "a\n[private_key]\nb"
    assert mask(f"a\n-----BEGIN PRIVATE KEY-----\n{body}") == "a\n[private_key]"
    assert mask(f"{key} c {key}") == "[private_key] c [private_key]"
    assert mask("x -----BEGIN PRIVATE KEY----- short words follow") == "x [private_key] short words follow"
    assert mask("postgres://u:p@ss/w@h/db ok") == "[login_url]h/db ok" and mask("https://u:p@s:s@host/@name") == "[login_url]host/@name"
    assert mask("https://u:p/w@host/x") == "[login_url]host/x" and mask("http://localhost:8080/users/@me") == "http://localhost:8080/users/@me"
    assert mask("Authorization: Bearer abcDEF123._~+/-abcdef== end") == "Authorization: [bearer] end"
    for made in ("github_pat_" + "a1_" * 20, "ASIA" + "ABCD1234" * 2, "sk-proj-" + "aB3" * 10, "glpat-" + "a1" * 10, "npm_" + "a1" * 18, "SG." + "a1" * 10 + "." + "b2" * 12):
        assert mask(f"say {made} now").startswith("say [") and made[6:] not in mask(f"say {made} now")
    assert mask("a task-force-of-many-long-words-here sk-but-no-figures-in-this-one") == "a task-force-of-many-long-words-here sk-but-no-figures-in-this-one"


def test_long_texts_without_an_end():
    many = "-----BEGIN PRIVATE KEY----- and on " * 20_000
    assert len(secrets.scanner(secrets.RULES).scan([many])[0]) == 20_000

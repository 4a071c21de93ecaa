"""Private keys' blocks with blank lines (F2)."""

import hashlib
import time

from closura.llm import queries, secret_scan


def test_a_double_spaced_block_without_an_end_takes_no_time():
    text = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n\n".join("A1b2" * 16 for _ in range(40)) + "\n\nno end"
    began = time.time()
    assert not list(secret_scan.BLOCK.finditer(text))
    assert time.time() - began < 5
    whole = text.replace("no end", "-----END RSA PRIVATE KEY-----")
    (m,) = secret_scan.BLOCK.finditer(whole)
    assert len(secret_scan.LINE.findall(m.group(1))) == 40


def test_query_on_odd_rows(spark, tmp_path):
    block = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n\n".join("A1b2" * 16 for _ in range(40)) + "\n\n"
    texts = [None, "", "to\u212aen: abcdefghijkl", "\u017fecret=abcdefghijkl", "API_Key' : 'abcdefghijkl", block + "pass\x00 SECRET =\"0123456789ab", "\U0001f600 AKIA" + "A" * 14 + " " + "0123456789abcdef"]
    spark.createDataFrame([(k if k else None, t, "en", "x") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op4_secret_scan(spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    at = len(block) + len("pass\x00 SECRET =\"")
    want = [(0, 0, 0, ""), (0, 0, 0, ""), (0, 0, 0, ""), (0, 0, 0, ""), (1, 0, 0, "assign:12:24"), (1, 0, 0, f"assign:{at}:{at + 12}"), (0, 1, 1, "access:2:20,hex:21:37")]
    for k, (a, b, c, base) in enumerate(want):
        r = got[k if k else None]
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == (a, b, c, sha(base)), texts[k]

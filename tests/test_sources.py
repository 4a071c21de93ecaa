import pytest

from closura import cli
from closura.sources import triples as src


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_encoded(spark, tmp_path):
    p = tmp_path / "a.ntenc"
    p.write_text("1 2 3\n\n4294967295 5 6 ignored\n")
    df = src.read_encoded(spark, str(p))
    assert rows(df) == {(1, 2, 3), (4294967295, 5, 6)}
    assert [f.nullable for f in df.schema] == [False] * 3


@pytest.mark.parametrize("line", ["1 2", "1 x 3", "1 2 -3", "1 2 4294967296", "1  2 3"])
def test_malformed(spark, tmp_path, line):
    p = tmp_path / "a.ntenc"
    p.write_text(f"1 2 3\n{line}\n")
    with pytest.raises(src.MalformedTriple, match=line):
        src.read_encoded(spark, str(p))
    with pytest.raises(Exception, match="malformed"):
        src.read_encoded(spark, str(p), check=False).collect()


def test_round_trips(spark, tmp_path):
    facts = spark.createDataFrame([(1, 2, 3), (4, 5, 6)], src.SIGNED.fieldNames()[:3])
    src.write_table(facts, str(tmp_path / "t"), by_predicate=True)
    assert rows(src.read_table(spark, str(tmp_path / "t"))) == {(1, 2, 3), (4, 5, 6)}
    src.write_encoded(facts, str(tmp_path / "e"))
    assert rows(src.read_encoded(spark, str(tmp_path / "e"))) == {(1, 2, 3), (4, 5, 6)}


def test_text_form(spark, tmp_path):
    p = tmp_path / "a.nt"
    p.write_text('# comment\n<http://x/a> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://x/C> .\n<http://x/a> <http://x/p> "a \\"b\\" c"@en .\n_:n <http://x/p> "1"^^<http://x/int> .\n')
    texts = src.read_ntriples(spark, str(p))
    ids = src.dictionary(texts)
    known = dict(rows(ids))
    assert known["<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"] == 4
    assert len(set(known.values())) == len(known) and min(i for t, i in known.items() if "http://x/" in t) >= 47
    assert rows(src.decode(src.encode(texts, ids), ids)) == rows(texts)
    p.write_text("<a> <b>\n")
    with pytest.raises(Exception, match="malformed"):
        src.read_ntriples(spark, str(p)).collect()


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    t, a = tmp_path / "t.ntenc", tmp_path / "a.ntenc"
    t.write_text("49 0 47\n51 0 53\n53 0 49\n55 1 57\n57 1 58\n57 4 11\n61 12 57\n62 2 49\n62 3 64\n")
    a.write_text("65 55 66\n65 4 51\n65 62 67\n65 57 68\n68 57 69\n69 57 70\n")
    assert cli.main([str(t), str(a), "rdfspp", "1", "1", "--log-dir", str(tmp_path)]) == 0
    out = capsys.readouterr().out
    assert "materialized abox triples: 28" in out
    log = next(tmp_path.glob("a_rdfspp_1_1_*.csv")).read_text().splitlines()
    assert log[0] == "file,latency,added,removed,worker" and log[1].split(",")[2:4] == ["28", "0"]

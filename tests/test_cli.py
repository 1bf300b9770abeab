import csv

from quarry import cli


def test_archives_there_and_back(spark, tmp_path):
    (tmp_path / "in" / "d").mkdir(parents=True)
    content = {"a.txt": b"abracadabra" * 9, "d/b.bin": bytes(range(256))}
    for name, data in content.items():
        (tmp_path / "in" / name).write_bytes(data)
    assert cli.main(["encode", "--codec", "huff", "--archives", "2", str(tmp_path / "in"), str(tmp_path / "arc")]) == 0
    assert cli.main(["decode", str(tmp_path / "arc"), str(tmp_path / "out")]) == 0
    assert {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()} == content
    assert cli.main(["report", str(tmp_path / "in"), str(tmp_path / "csv")]) == 0
    rows = list(csv.DictReader(next((tmp_path / "csv").glob("part-*.csv")).open()))
    assert {r["filename"] for r in rows} == set(content) and all(int(r["g8"]) == int(r["e8"]) + 256 for r in rows)

from parcelgraph.streaming.packages import watch
from tests.test_packages import document


def test_new_files_are_parsed_once(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    for n in (1, 2):
        (folder / f"{n}.json").write_text(document())
        watch(spark, str(folder), lambda p: seen.append(p.entities.count()), str(tmp_path / "cp")).awaitTermination()
    assert seen == [3, 3]

"""File functions of parameter expressions, through Spark's file systems."""

import os

from rasterloom.functions.parameters import resolved


def test_files_and_folders(spark, tmp_path):
    a, b = tmp_path / "a.txt", tmp_path / "b.txt"
    a.write_text("x")
    b.write_text("y")
    os.utime(a, (1_000_000, 1_000_000))
    for head in ("", "file://"):
        of = lambda name, *paths: resolved(f"$[func:{name}({','.join(head + str(p) for p in paths)})]$")
        assert (of("isFile", a), of("isFile", tmp_path), of("isFile", tmp_path / "no")) == ("1", "0", "0")
        assert (of("isDir", a), of("isDir", tmp_path), of("isDir", tmp_path / "no")) == ("0", "1", "0")
        assert (of("fileOneIsNewer", b, a), of("fileOneIsNewer", a, b), of("fileOneIsNewer", a, tmp_path / "no")) == ("1", "0", "1")

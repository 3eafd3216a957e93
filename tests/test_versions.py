import os

import micro
import pytest

from termspire import Layout
from termspire.plans.staging import new_folder
from termspire.sinks import write_index
from termspire.sinks.index_files import drop_old_versions
from termspire.sources import read_index


def test_a_failed_write_leaves_the_index_as_it_was(spark, monkeypatch):
    from termspire.sinks import index_files

    root = new_folder(spark, "versions")
    first = write_index(micro.index(spark), root, Layout("shift", 1))
    rows = sorted(map(tuple, first.postings.collect()))

    def fails(*rest):
        raise OSError("no space")

    with monkeypatch.context() as patched:
        patched.setattr(index_files, "write_postings", fails)
        with pytest.raises(OSError):
            write_index(micro.index(spark), root, Layout("hash", 2))
    again = read_index(spark, root)
    assert again.layout == Layout("shift", 1) and sorted(map(tuple, again.postings.collect())) == rows
    second = write_index(micro.index(spark), root, Layout("hash", 2))
    assert second.layout == Layout("hash", 2)
    assert sorted(map(tuple, first.postings.collect())) == rows  # the reader of the old one goes on
    drop_old_versions(spark, root)
    left = os.listdir(root.removeprefix("file:"))
    assert sum(n.startswith("version-") for n in left) == 1 and read_index(spark, root).dict.count() > 0

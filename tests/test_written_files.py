"""Files that queries write for themselves grow in number, not in size."""

import glob

import pytest

from voxmetric.plans.catalogue import ENTRIES, Tables, files
from voxmetric.sources import csv_blocks
from voxmetric.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["file_blocks", "stream_ingest", "stream_rejects"])
def test_no_file_holds_a_fixed_share(spark, name, monkeypatch):
    seen = []
    for module, reader in ((csv_blocks, "read_blocks"), (jobs, "export_stream")):
        monkeypatch.setattr(module, reader, lambda s, path, f=getattr(module, reader): (seen.append(path), f(s, path))[1])
    monkeypatch.setattr(files, "_ROWS", 100)
    tables = Tables(spark, SF)
    rows = tables.export.count()
    ENTRIES[name].run(tables).count()
    written = [spark.read.option("multiLine", True).option("header", True).option("escape", '"').csv(f).count() for f in glob.glob(f"{seen[0]}/*.csv")]
    assert sum(written) == rows and rows > 1000
    assert max(written) <= 110

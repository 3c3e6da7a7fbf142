from __future__ import annotations

from strandlake.plans import commands
from strandlake.streaming import archive_arrivals
from tests.test_archive import fastq


def test_arrivals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.fastq").write_text(fastq(5, i))
        q = archive_arrivals(spark, f"file://{tmp_path}/in", str(tmp_path / "out"), f"file://{tmp_path}/state", profile="ont")
        assert q.awaitTermination(120)
        assert len(list((tmp_path / "out").iterdir())) == i + 1
    assert commands.verify(spark, str(tmp_path / "out" / "1.fastq.arc")).records == 5

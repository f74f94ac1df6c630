"""Pinned sources: where a table comes from, at a revision that cannot move."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from .tables import first_n


@dataclass(frozen=True)
class Source:
    key: str
    repository: str
    revision: str
    config: str | None
    split: str

    def __post_init__(self):
        if len(self.revision) != 40 or set(self.revision) - set("0123456789abcdef"):
            raise ValueError(f"{self.key}: {self.revision!r} is no full commit id; branches and tags move")

    def path(self, root: str) -> str:
        return "/".join([root.rstrip("/"), self.repository, self.revision, self.config or "default", f"{self.split}.parquet"])

    def describe(self) -> dict[str, str | None]:
        return asdict(self)


#: The public datasets and their revisions.
SOURCES = {
    s.key: s
    for s in (
        Source("huatuo_sft_en", "FreedomIntelligence/medical-o1-reasoning-SFT", "fc2c9e8a37b38f38da6d449564a8c350b244aef4", "en", "train"),
        Source("huatuo_verifiable", "FreedomIntelligence/medical-o1-verifiable-problem", "46d5175eb74fdef3516d51d52e8c40db04bbdf35", "default", "train"),
        Source("medqa_usmle", "GBaker/MedQA-USMLE-4-options", "0fb93dd23a7339b6dcd27e241cb9b5eca62d4d18", None, "test"),
        Source("medmcqa", "openlifescienceai/medmcqa", "91c6572c454088bf71b679ad90aa8dffcd0d5868", None, "validation"),
        Source("pubmedqa_labeled", "qiaojin/PubMedQA", "9001f2853fb87cab8d220904e0de81ac6973b318", "pqa_labeled", "train"),
    )
}


def load(spark: SparkSession, source: Source, root: str, limit: int | None = None, order: str = "row_index") -> DataFrame:
    """A source's Parquet copy under ``root``; the first ``limit`` rows by ``order``, all for None."""
    return first_n(spark.read.parquet(source.path(root)), order, limit)

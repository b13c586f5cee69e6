"""Packet lists as a stream: files are read as they arrive, as the batch reader reads them.

A file arrives whole in one micro-batch.  The stream carries names only; each
micro-batch reads its files with the reader of lists, so encoding, overlong rows,
records over several lines and foreign headers are decided per file as ever.  The header
that the first readable file sets, and what was decided about odd files, are kept in small tables
versioned by batch id, so that a repeated batch decides alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from packetweave.sources import packets as readers

FILES = "path string, modificationTime timestamp, length bigint, content binary"
EMPTY = "capture_id string, frame_number bigint, timestamp double, src_ip string, dst_ip string, protocol string, length double, info string"
DECIDED = "file string, capture_id string, latin1 boolean, ragged boolean, reason string"
# Names of so many files at most come to the driver per micro-batch.
FILES_PER_BATCH = 1000


@dataclass
class ListArrivals:
    """Reads the lists of each micro-batch; its tables lie under ``folder``."""

    folder: str
    profile: str = "extended"
    mode: str = "auto"
    capture_by: str = "file_path"

    def stream(self, spark: SparkSession, source: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
        """One row per file that arrives in ``source``; contents are not read here."""
        reader = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch)
        return reader.load(source).select("path", "length")

    def header(self, spark: SparkSession, batch_id: int) -> str | None:
        """The header that batches before this one have set."""
        try:
            known = spark.read.schema("batch_id bigint, header string").option("recursiveFileLookup", True).parquet(f"{self.folder}/header")
        except AnalysisException:
            return None
        row = known.filter(F.col("batch_id") < batch_id).orderBy("batch_id").first()
        return row["header"] if row else None

    def packets(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Packets of the files of one micro-batch; refused files are listed in ``files``."""
        spark = batch.sparkSession
        # Empty files hold no packets and can't set a header.
        paths = sorted(r["path"] for r in batch.filter("length > 0").select("path").collect())
        known = self.header(spark, batch_id)
        if not paths:
            return spark.createDataFrame([], EMPTY)
        lists = readers.read_lists(spark, paths, self.profile, self.mode, self.capture_by, known)
        if known is None:
            row = spark.createDataFrame([(batch_id, lists.header)], "batch_id bigint, header string")
            row.write.mode("overwrite").parquet(f"{self.folder}/header/set-{batch_id}")
        ragged = (~F.col("closed") | (F.col("overlong") > 0)).alias("ragged")
        told = lists.files.select(F.col("_file").alias("file"), "capture_id", "latin1", ragged).join(
            lists.refused.select("file", "reason"), "file", "left")
        told.select("file", "capture_id", "latin1", "ragged", "reason").write.mode("overwrite").parquet(f"{self.folder}/files/batch={batch_id}")
        return lists.packets

    def files(self, spark: SparkSession) -> DataFrame:
        """What was decided about the odd files so far."""
        return spark.read.schema(DECIDED + ", batch bigint").parquet(f"{self.folder}/files")

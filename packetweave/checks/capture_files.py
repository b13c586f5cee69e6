"""Capture files written from packets, for the queries over the given tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from packetweave.sources.captures import _located

# Bytes kept of each packet, all zero.
KEPT_BYTES = 32


def write_capture_files(packets: DataFrame, folder: str) -> int:
    """One pcap file per capture, in frame order, written by the task that holds the capture; returns how many."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = _located(folder)
        system.create_dir(inner, recursive=True)
        now, stream, names = None, None, []
        for batch in batches:
            for capture, seconds, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if capture != now:
                    if stream:
                        stream.close()
                    now, stream = capture, system.open_output_stream(f"{inner}/{capture}.pcap")
                    names.append(capture)
                    stream.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, KEPT_BYTES, 1))
                whole, micros = divmod(round((seconds or 0.0) * 1e6), 10**6)
                held = min(int(length or 0), KEPT_BYTES)
                stream.write(struct.pack("<4I", whole, micros, held, int(length or 0)) + bytes(held))
        if stream:
            stream.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["capture_id"])

    dealt = packets.repartition("capture_id").sortWithinPartitions("capture_id", "frame_number")
    return dealt.select("capture_id", "timestamp", "length").mapInArrow(write, "capture_id string").count()

"""Format-16 waveform records as a data source whose partitions are stretches of samples."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from pulsegrid.schema import LEADS

SCHEMA = "record_id string, lead string, fs int, i int, mv double"
#: Bytes of a partition, if not given.
STRETCH = 8 << 20
_BATCH = 65_536
_LEADS = {lead.upper(): lead for lead in LEADS}


@dataclass
class Stretch(InputPartition):
    """Samples first .. first + n - 1 of all channels of one file."""

    record_id: str
    path: str
    fs: int
    first: int
    n: int
    channels: list[tuple[str, float, int]]


def _located(path: str):
    """(file system, path within it) of a folder, local or by URI."""
    return pafs.FileSystem.from_uri(path) if re.match(r"\w+://|file:", path) else (pafs.LocalFileSystem(), path)


def header(text: str) -> tuple[str, int, int, dict[str, list[tuple[str, float, int]]]]:
    """(record, sampling rate, samples, channels (lead, gain, baseline) of each file) of a header."""
    lines = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    record, _, rate, samples = lines[0][:4]
    files: dict[str, list[tuple[str, float, int]]] = {}
    for name, fmt, scale, *rest in lines[1:]:
        if fmt != "16":
            raise ValueError(f"{record}: format {fmt} is not 16")
        gain, base = re.match(r"([-0-9.]+)?(?:\((-?\d+)\))?", scale).groups()
        zero = int(base) if base else int(rest[1]) if len(rest) > 1 else 0
        lead = rest[-1]
        files.setdefault(name, []).append((_LEADS.get(lead.upper(), lead), float(gain or 0) or 200.0, zero))
    return record, int(float(rate.split("/")[0])), int(samples), files


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.stretch, self.wanted = options["path"], int(options.get("stretch", STRETCH)), None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("record_id",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            yield f  # files are told apart by record, rows are checked by Spark

    def partitions(self):
        files, root = _located(self.path)
        out = []
        for found in files.get_file_info(pafs.FileSelector(root, recursive=True)):
            if found.extension != "hea" or self.wanted is not None and found.base_name[:-4] not in self.wanted:
                continue
            record, rate, samples, channels = header(files.open_input_stream(found.path).read().decode())
            for name, each in channels.items():
                path = f"{found.path.rpartition('/')[0]}/{name}"
                samples = samples or files.get_file_info(path).size // (2 * len(each))
                n = max(1, self.stretch // (2 * len(each)))
                out += [Stretch(record, path, rate, at, min(n, samples - at), each) for at in range(0, samples, n)]
        return out

    def read(self, part: Stretch):
        files, _ = _located(self.path)
        width = 2 * len(part.channels)
        with files.open_input_file(part.path) as file:
            for at in range(part.first, part.first + part.n, _BATCH):
                file.seek(at * width)
                raw = np.frombuffer(file.read(width * min(_BATCH, part.first + part.n - at)), "<i2")
                adc = raw[: len(raw) // len(part.channels) * len(part.channels)].reshape(-1, len(part.channels))
                for k, (lead, gain, zero) in enumerate(part.channels):
                    n = len(adc)
                    columns = [pa.array([part.record_id] * n), pa.array([lead] * n), pa.array(np.full(n, part.fs, np.int32)), pa.array(np.arange(at, at + n, dtype=np.int32)), pa.array((adc[:, k] - zero) / gain)]
                    yield pa.RecordBatch.from_arrays(columns, names=["record_id", "lead", "fs", "i", "mv"])


class WfdbSource(DataSource):
    """spark.read.format("wfdb16").option("stretch", bytes).load(folder): record_id, lead, fs, i, mv.

    Every partition reads its own bytes, so a long file is read by several
    tasks.  Headers are listed and parsed when the query is planned, those of the
    records asked for by record_id only; files are named by their record.
    """

    @classmethod
    def name(cls):
        return "wfdb16"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to the session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WfdbSource)

"""S1 as a streaming source with offsets of its own: ``format("cart_journal")``.

The file source of Spark knows files; this one knows events. Its offset is the
journal's: (time, id) of the last event read, the same pair the offset table
(S8), the offset filter (P8) and a table's version carry, so a stream can stop
anywhere, also among the events of one time, and anything can resume there.

The driver reads parquet footers only (each file's once) and, to end a batch
after ``max_events``, the two offset columns of the row groups around that
event. A task reads the row groups of one file that the batch's range touches
and hands on Arrow batches. Events must be appended in offset order, as in the
original: one that arrives with an offset already passed is not read. Events
without an offset are in no range.

Options: ``path``, ``tag`` (one directory of the journal); ``start_ts`` and
``start_id`` (read strictly after this event; default: from the first);
``until_ts`` and ``until_id`` (stop there); ``max_events`` (of a micro-batch);
``checkpoint`` (the query's, so that a restarted reader goes on where the
checkpoint stands).
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

#: Before every event.
FIRST = (-1, "")


@dataclass
class RowGroups(InputPartition):
    file: str
    groups: list
    after: tuple
    upto: tuple


class JournalSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cart_journal"

    def schema(self):
        from carthouse.sources.journal import STORED
        return STORED

    def streamReader(self, schema) -> "JournalReader":
        return JournalReader(schema, dict(self.options))


class JournalReader(DataSourceStreamReader):
    def __init__(self, schema, options: dict):
        self.schema, self.options = schema, options
        self.folder = f"{options['path'].rstrip('/')}/tag={options['tag']}"
        self.start = (int(options.get("start_ts", FIRST[0])), options.get("start_id", FIRST[1]))
        self.until = (int(options["until_ts"]), options["until_id"]) if "until_ts" in options else None
        self.max_events = int(options.get("max_events", 0))
        self.position = None
        self.footers: dict = {}  # file -> [(row group, rows, lowest time, highest time)]

    def initialOffset(self) -> dict:
        return _offset(self.start)

    def latestOffset(self) -> dict:
        if self.position is None:
            self.position = max(self.start, self._checkpointed())
        # An offset Spark has seen before starts no batch; it then asks for the next one.
        self.position = self._end_after(self.position)
        return _offset(self.position)

    def partitions(self, start: dict, end: dict):
        after, upto = _pair(start), _pair(end)
        out = []
        for file, groups in self._groups().items():
            hit = [g for g, _, low, high in groups if high >= after[0] and low <= upto[0]]
            if hit and after < upto:
                out.append(RowGroups(file, hit, after, upto))
        return out

    def read(self, partition: RowGroups):
        schema = to_arrow_schema(self.schema)
        files, path = pafs.FileSystem.from_uri(partition.file)
        with files.open_input_file(path) as opened:
            source = pq.ParquetFile(opened)
            for batch in source.iter_batches(row_groups=partition.groups):
                rows = pa.Table.from_batches([batch]).filter(
                    _between(batch.column("offset_ts"), batch.column("offset"), partition.after, partition.upto))
                rows = rows.append_column("tag", pa.array([self.options["tag"]] * len(rows), pa.string()))
                yield from rows.select(schema.names).cast(schema).to_batches()

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass

    def _groups(self) -> dict:
        files, folder = pafs.FileSystem.from_uri(self.folder)
        scheme = self.folder[:self.folder.index("://") + 3] if "://" in self.folder else ""
        for info in files.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
            name = info.base_name
            if info.type != pafs.FileType.File or not name.endswith(".parquet") or name[0] in "._":
                continue
            uri = f"{self.folder}/{name}" if scheme else info.path
            if uri not in self.footers:
                with files.open_input_file(info.path) as opened:
                    self.footers[uri] = _row_groups(pq.ParquetFile(opened).metadata)
        return self.footers

    def _end_after(self, position: tuple) -> tuple:
        """The offset at which the batch after ``position`` ends: ``max_events`` events on, or the newest."""
        groups = sorted((low, high, rows, file, g) for file, found in self._groups().items()
                        for g, rows, low, high in found if high >= position[0])
        if self.until is not None:
            groups = [g for g in groups if g[0] <= self.until[0]]
        if not self.max_events:
            newest = position
            for _, high, _, file, g in sorted(groups, key=lambda g: -g[1]):
                if high < newest[0]:
                    break
                newest = _last(self._offsets(file, g, newest)) or newest
            return newest
        found, bound = [], None  # the least pairs so far and, where they are enough, the greatest of them
        for low, _, _, file, g in groups:
            if bound is not None and low > bound[0]:
                break
            found.append(self._offsets(file, g, position, bound))
            if sum(len(rows) for rows in found) >= 2 * self.max_events:
                rows, bound = _least(found, self.max_events)
                found = [rows]
        rows, _ = _least(found, self.max_events)
        return _last(rows) or position

    def _offsets(self, file: str, group: int, position: tuple, upto: tuple | None = None) -> pa.Table:
        """(time, id) of a row group's events after ``position`` and up to ``until``, or a lesser ``upto``."""
        files, path = pafs.FileSystem.from_uri(file)
        with files.open_input_file(path) as opened:
            rows = pq.ParquetFile(opened).read_row_group(group, columns=["offset_ts", "offset"])
        upto = upto or self.until or (2 ** 63 - 1, "\U0010ffff")
        return rows.filter(_between(rows.column("offset_ts"), rows.column("offset"), position, upto))

    def _checkpointed(self) -> tuple:
        """The end of the newest batch the query's checkpoint has planned."""
        if "checkpoint" not in self.options:
            return FIRST
        files, folder = pafs.FileSystem.from_uri(f"{self.options['checkpoint'].rstrip('/')}/offsets")
        planned = [int(i.base_name) for i in files.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
                   if i.base_name.isdigit()]
        if not planned:
            return FIRST
        with files.open_input_file(f"{folder}/{max(planned)}") as opened:
            return _pair(json.loads(opened.read().decode().splitlines()[-1]))


def _least(found: list, most: int) -> tuple[pa.Table | None, tuple | None]:
    """(the ``most`` least pairs and any that equal the greatest of them, that one or None where there are fewer)."""
    if not found:
        return None, None
    rows = pa.concat_tables(found)
    if len(rows) < most:
        return rows, None
    times = rows.column("offset_ts").to_numpy()
    at = int(np.partition(times, most - 1)[most - 1])
    tied = rows.column("offset").filter(pc.equal(rows.column("offset_ts"), at))
    ids = tied.take(pc.sort_indices(tied))
    bound = at, ids[most - int((times < at).sum()) - 1].as_py()
    return rows.filter(_between(rows.column("offset_ts"), rows.column("offset"), FIRST, bound)), bound


def _last(rows: pa.Table | None) -> tuple | None:
    """The greatest pair."""
    if rows is None or not len(rows):
        return None
    at = pc.max(rows.column("offset_ts"))
    return at.as_py(), pc.max(rows.column("offset").filter(pc.equal(rows.column("offset_ts"), at))).as_py()


def _offset(pair: tuple) -> dict:
    return {"ts": pair[0], "id": pair[1]}


def _pair(offset: dict) -> tuple:
    return int(offset["ts"]), offset["id"]


def _between(ts, ids, after: tuple, upto: tuple):
    """P8 on Arrow columns: strictly after one offset, up to another; null offsets are in no range."""
    later = pc.or_kleene(pc.greater(ts, after[0]), pc.and_kleene(pc.equal(ts, after[0]), pc.greater(ids, after[1])))
    within = pc.or_kleene(pc.less(ts, upto[0]), pc.and_kleene(pc.equal(ts, upto[0]), pc.less_equal(ids, upto[1])))
    return pc.fill_null(pc.and_kleene(pc.and_kleene(later, within), pc.is_valid(ids)), False)


def _row_groups(footer) -> list[tuple]:
    out = []
    for g in range(footer.num_row_groups):
        group = footer.row_group(g)
        for c in range(group.num_columns):
            column = group.column(c)
            if column.path_in_schema == "offset_ts":
                found = column.statistics
                if found is None or not found.has_min_max:
                    if found is None or found.null_count < group.num_rows:
                        out.append((g, group.num_rows, FIRST[0], 2 ** 63 - 1))  # no statistics: may hold any time
                else:
                    out.append((g, group.num_rows, found.min, found.max))
    return out


def stream_events(spark: SparkSession, path: str, tag: str, checkpoint: str, after: tuple | None = None,
                  until: tuple | None = None, max_events: int | None = None) -> DataFrame:
    """The journal's events with a tag, strictly after an offset (time, id), as a stream in offset order of its
    micro-batches."""
    import sys

    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(JournalSource)
    options = {"path": path, "tag": tag, "checkpoint": checkpoint}
    if after is not None:
        options |= {"start_ts": str(after[0]), "start_id": after[1]}
    if until is not None:
        options |= {"until_ts": str(until[0]), "until_id": until[1]}
    if max_events:
        options["max_events"] = str(max_events)
    return spark.readStream.format("cart_journal").options(**options).load()

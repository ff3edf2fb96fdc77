"""Named graphs as folders of Parquet, and changes to them.

A graph has a log: small numbered files, of which each names a folder of facts that were added, or of keys that were taken away. A change
writes what is new and then its number in the log. A number can be taken once, so of two writers at once the later one sees that the
graph moved and begins again with what is there now. Readers keep the facts that they began with, and a statement may read the graph that
it changes. compact() writes a graph's facts anew, and vacuum() removes the files that no graph needs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce
from itertools import groupby
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import COLUMNS, FACTS
from ..operators.patterns import Clause, Filter, match
from ..operators.templates import Template, construct
from .text import write_facts

KEYS = ["s", "p", "o"]
#: How often a change begins again when others write to its graph.
TRIES = 5


class GraphError(ValueError):
    """What went wrong with each of several graphs, joined by semicolons."""


class _Moved(Exception):
    """Another writer took the number."""


def _raise(problems: list[str]) -> None:
    if problems:
        raise GraphError("; ".join(problems))


def _empty(log: list[dict]) -> bool:
    """Whether nothing was ever added to the graph of a log."""
    return all(change["kind"] == "create" for change in log)


def _each_once(facts: DataFrame) -> DataFrame:
    """One of the facts of each key, of facts that are dealt by their keys.

    A predicate's key has its name, so the name changes no group, and repeats are found in the order in which facts are written: by one sort.
    What else a fact has is one value, since a function for each column costs more than all else here.
    """
    rest = [c for c in COLUMNS if c not in ("p_id", *KEYS)]
    return facts.groupBy("p_id", *KEYS).agg(F.first(F.struct(*rest)).alias("rest")).select("p_id", *KEYS, "rest.*").select(*COLUMNS)


class Graphs:
    """Graphs under a folder that Spark can write. Names are written with their question mark, as in ?family."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _listed(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(x.getPath().getName() for x in self._files.listStatus(path)) if self._files.exists(path) else []

    def _log(self, graph: str) -> tuple[int, list[dict] | None]:
        """The number of a graph's last change, and its changes since it was created or compacted; None if there is no such graph."""
        numbers, found = self._listed(f"{self.folder}/log/{quote(graph, safe='')}"), []
        for number in reversed(numbers):
            stream = self._files.open(self._path(f"{self.folder}/log/{quote(graph, safe='')}/{number}"))
            try:
                change = json.loads(bytes(stream.readAllBytes()))
            finally:
                stream.close()
            if change["kind"] == "drop":
                return int(numbers[-1]), found[::-1] if found else None
            found.append(change)
            if change["kind"] in ("create", "compact"):
                break
        return int(numbers[-1]) if numbers else 0, found[::-1] if found else None

    def _note(self, graph: str, number: int, kind: str, folder: str = "") -> None:
        """Takes a number of a graph's log."""
        path = self._path(f"{self.folder}/log/{quote(graph, safe='')}/{number:012d}")
        try:
            stream = self._files.create(path, False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                raise _Moved from e
            raise
        try:
            stream.write(bytearray(json.dumps({"kind": kind, "folder": folder}).encode()))
        finally:
            stream.close()

    def _changed(self, graph: str, change: Callable[[list[dict]], tuple[str, DataFrame | None]]) -> tuple[list[dict], str]:
        """Makes a change of what a graph's log says, and begins again if another writer was quicker. Returns that log and the change's folder."""
        for _ in range(TRIES):
            number, log = self._log(graph)
            if log is None:
                raise GraphError(f"graph {graph} does not exist")
            kind, rows = change(log)
            folder = f"facts/{uuid.uuid4().hex}"
            if rows is not None:
                rows.write.parquet(f"{self.folder}/{folder}")
            try:
                self._note(graph, number + 1, kind, folder)
                return log, folder
            except _Moved:
                continue
        raise GraphError(f"graph {graph} was changed by others {TRIES} times")

    def _facts(self, log: list[dict]) -> DataFrame:
        """The facts that changes leave."""
        facts: DataFrame | None = None
        # runs of changes of one kind are read together
        for kind, run in groupby(log, key=lambda change: "remove" if change["kind"] == "remove" else "add"):
            folders = [f"{self.folder}/{change['folder']}" for change in run if change["folder"]]
            if kind == "remove" and facts is not None:
                facts = facts.join(self.spark.read.parquet(*folders), KEYS, "left_anti").select(*COLUMNS)
            elif kind == "add" and folders:
                new = self.spark.read.schema(FACTS).parquet(*folders)
                facts = new if facts is None else facts.union(new)
        return self.spark.createDataFrame([], FACTS) if facts is None else facts

    def names(self) -> DataFrame:
        """graph_id of every graph."""
        return self.spark.createDataFrame([(g,) for g in self._names()], "graph_id string")

    def _names(self) -> list[str]:
        found = [unquote(x) for x in self._listed(f"{self.folder}/log")]
        return sorted(g for g in found if self._log(g)[1] is not None)

    def create(self, *graphs: str) -> None:
        """Creates what can be created; then one error for those that exist."""
        bad = []
        for g in graphs:
            number, log = self._log(g)
            try:
                if log is not None:
                    raise _Moved
                self._note(g, number + 1, "create")
            except _Moved:
                bad.append(f"graph {g} exists")
        _raise(bad)

    def drop(self, *graphs: str) -> None:
        """Drops what is there; then one error for what isn't."""
        bad = []
        for g in graphs:
            try:
                self._changed(g, lambda log: ("drop", None))
            except GraphError as e:
                bad.append(str(e))
        _raise(bad)

    def read(self, *graphs: str) -> DataFrame:
        """All facts of the graphs; a graph named twice is read twice."""
        logs = {g: self._log(g)[1] for g in graphs}
        _raise([f"graph {g} does not exist" for g in graphs if logs[g] is None])
        return reduce(DataFrame.union, [self._facts(logs[g]) for g in graphs])

    def insert(self, facts: DataFrame, *graphs: str) -> None:
        """Adds facts to each graph; those it has change nothing. What a graph holds is read for its keys only and never written again."""

        once: str | None = None  # a folder that has each of the facts once, as an empty graph among these got them

        def added(log: list[dict], graph: str) -> tuple[str, DataFrame]:
            if once:
                new = self.spark.read.schema(FACTS).parquet(once)
            else:
                new = facts.select(*COLUMNS).repartition(*KEYS)
            new = new.withColumn("graph", F.lit(graph)).select(*COLUMNS)
            if not _empty(log):
                # the side that grows with the input is first cut to what both have; for that, repeats do no harm
                there = self._facts(log).select(*KEYS).join(facts.select(*KEYS), KEYS, "left_semi")
                new = new.join(there, KEYS, "left_anti").select(*COLUMNS)
            # near each other lie the facts of one predicate, so its scans skip row groups
            return "add", (new if once else _each_once(new)).sortWithinPartitions("p_id", "s")

        for g in graphs:
            log, folder = self._changed(g, lambda log, g=g: added(log, g))
            if _empty(log):
                once = f"{self.folder}/{folder}"

    def delete(self, facts: DataFrame, *graphs: str) -> None:
        """Removes facts from each graph; those it lacks change nothing. Only their keys are written."""
        for g in graphs:
            self._changed(g, lambda log: ("remove", facts.select(*KEYS).distinct()))

    def compact(self, *graphs: str) -> None:
        """Writes the facts of each graph anew, so that reading it no longer depends on how often it was changed."""
        for g in graphs:
            self._changed(g, lambda log: ("compact", self._facts(log).repartitionByRange("p_id", "s").sortWithinPartitions("p_id", "s")))

    def vacuum(self) -> int:
        """Removes the folders that no graph needs, and returns their number. Readers and writers that are under way may need them still."""
        needed = {change["folder"] for g in self._names() for change in self._log(g)[1]}
        gone = [x for x in self._listed(f"{self.folder}/facts") if f"facts/{x}" not in needed]
        for x in gone:
            self._files.delete(self._path(f"{self.folder}/facts/{x}"), True)
        return len(gone)

    def export(self, path: str, *graphs: str) -> None:
        """The facts of several graphs as one folder of fact lines."""
        write_facts(self.read(*graphs), path)

    def _made(self, templates: list[Template], sources: tuple[str, ...], clauses: list[Clause], filters: tuple[Filter, ...], having) -> DataFrame:
        rows = match(self.read(*sources), clauses, filters)
        return construct(rows if having is None else rows.filter(having), templates, ("?",))

    def construct(self, templates: list[Template], into: tuple[str, ...], sources: tuple[str, ...], clauses: list[Clause], filters: tuple[Filter, ...] = (), having=None) -> None:
        self.insert(self._made(templates, sources, clauses, filters, having), *into)

    def deconstruct(self, templates: list[Template], out_of: tuple[str, ...], sources: tuple[str, ...], clauses: list[Clause], filters: tuple[Filter, ...] = (), having=None) -> None:
        if any(t.more for t in templates):
            raise ValueError("facts about facts are named anew and can't be taken away by template")
        self.delete(self._made(templates, sources, clauses, filters, having), *out_of)

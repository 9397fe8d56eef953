"""Session registry and nested session files."""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import SESSION_FILES, SESSION_PROFILES
from .schemas import META_SCHEMA, PUSH_SCHEMA, TRANSFER_SCHEMA
from .writers import write_json


@dataclass(frozen=True)
class SessionSource:
    label: str
    path: str
    profile: str


#: The option syntax LABEL=VALUE; blanks around either side don't count.
_PAIR = re.compile(r"\s*(?P<label>[^=]*[^=\s])\s*=\s*(?P<value>\S.*?)\s*", re.S)


def _pairs(options: Iterable[str] | Mapping[str, str], faults: list[str]) -> list[tuple[str, str]]:
    """(label, value) of options or of a mapping; what can't be read is noted in ``faults``."""
    if isinstance(options, Mapping):
        return list(options.items())
    read = [(text, _PAIR.fullmatch(text)) for text in options]
    faults += [f"not a label with a value: {text!r}" for text, match in read if match is None]
    return [(match["label"], match["value"]) for _, match in read if match]


def _local_folder(path: str) -> str:
    return path if "://" in path else os.path.abspath(os.path.expanduser(path))


def session_registry(
    folders: Iterable[str] | Mapping[str, str], profiles: Iterable[str] | Mapping[str, str] = (), *,
    labels: Iterable[str] | None = tuple(SESSION_PROFILES), probe: bool = True,
) -> list[SessionSource]:
    """One source per session from label-to-folder and label-to-profile pairs.

    All faults are found before the registry is refused, with one ValueError that lists them. ``labels`` is the exact
    set of sessions of a study, None takes any. ``probe`` looks for the four files in folders of the local file
    system; folders of other stores are checked by the read.
    """
    faults: list[str] = []
    placed, named = _pairs(folders, faults), _pairs(profiles, faults)
    counts = Counter(label for label, _ in placed)
    faults += [f"{label} has {n} folders" for label, n in counts.items() if n > 1]
    expected = list(counts) if labels is None else list(labels)
    faults += [f"{label} has no folder" for label in expected if label not in counts]
    faults += [f"{label} is no session of this study" for label in counts if label not in expected]
    faults += [f"a profile names {label}, which is no session" for label, _ in named if label not in expected]
    if faults:
        raise ValueError("session registry: " + "; ".join(faults))
    folder, profile = dict(placed), {**SESSION_PROFILES, **dict(named)}
    sources = [SessionSource(label, _local_folder(folder[label]), profile.get(label, "")) for label in expected]
    wanted = [f"{s.path}/{name}" for s in sources if "://" not in s.path for name in SESSION_FILES] if probe else []
    if gone := [path for path in wanted if not os.path.isfile(path)]:
        raise FileNotFoundError(f"session files not found: {gone}")
    return sources


def read_sessions(spark: SparkSession, sources: list[SessionSource]) -> Mapping[str, DataFrame]:
    """The four files of every session, one row per session each, labelled.

    A byte order mark is accepted. Malformed JSON fails the read.
    """
    registry = spark.createDataFrame(
        [(s.label, s.path.rstrip("/"), s.profile) for s in sources], "session string, _dir string, profile string"
    )

    def read(name: str, schema: str) -> DataFrame:
        reader = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST")
        rows = reader.json([f"{s.path.rstrip('/')}/{name}" for s in sources])
        folder = F.regexp_replace(
            F.regexp_replace(F.col("_metadata.file_path"), r"/[^/]*$", ""), r"^file:/+", "/"
        )
        return rows.withColumn("_dir", F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))).join(registry, "_dir").drop("_dir")

    return {
        "p1": read(SESSION_FILES[0], TRANSFER_SCHEMA),
        "p2": read(SESSION_FILES[1], PUSH_SCHEMA),
        "p3": read(SESSION_FILES[2], TRANSFER_SCHEMA),
        "meta": read(SESSION_FILES[3], META_SCHEMA),
    }


#: Folders of a session store, by the key that the plans use.
_STORE = {"p1": TRANSFER_SCHEMA, "p2": PUSH_SCHEMA, "p3": TRANSFER_SCHEMA, "meta": META_SCHEMA}


def write_session_store(tables: Mapping[str, DataFrame], folder: str) -> None:
    """The documents of any number of sessions, one JSON line each, in one folder per kind of file."""
    for key in _STORE:
        write_json(tables[key], f"{folder.rstrip('/')}/{key}")


def read_session_store(spark: SparkSession, folder: str) -> Mapping[str, DataFrame]:
    """What ``write_session_store`` wrote, as ``read_sessions`` returns it.

    The label and the profile of a session are fields of its documents, so no list of sessions passes the driver. Fields
    without a value may be absent; malformed JSON fails the read.
    """
    return {
        key: spark.read.schema(f"session STRING, profile STRING, {schema}").option("mode", "FAILFAST").json(f"{folder.rstrip('/')}/{key}")
        for key, schema in _STORE.items()
    }

"""Where session files may lie, and formats of one's own beside the built-in ones."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.sources import adapters

# Where the agents keep their sessions, below a home directory; variables that name another place.
HOME_ROOTS = {"codex-jsonl": [".codex/sessions", ".codex/archived_sessions"], "claude-code-jsonl": [".claude/projects"], "workbuddy-jsonl": [".workbuddy/projects"], "neo-claude-jsonl": [".neo/projects"], "cursor-agent-jsonl": [".cursor/projects"], "clacky-json": [".clacky/sessions"]}
VARIABLES = {"codex-jsonl": ("CODEX_HOME", "sessions"), "claude-code-jsonl": ("CLAUDE_CONFIG_DIR", "projects")}
_NAME = re.compile(r"[a-z0-9][a-z0-9-]*")


def root_hints(environment: dict[str, str] | None = None, home: str | None = None) -> list[tuple[str, str]]:
    """(adapter, folder) of every folder that exists and where sessions are usually kept; variables come before the home's own folders."""
    env = dict(os.environ) if environment is None else environment
    base = home if home is not None else env.get("HOME") or env.get("USERPROFILE") or ""
    named = [(a, os.path.join(env[v], sub)) for a, (v, sub) in VARIABLES.items() if env.get(v)]
    usual = [(a, os.path.join(base, sub)) for a, subs in HOME_ROOTS.items() for sub in subs] if base else []
    return list(dict.fromkeys((a, os.path.normpath(p)) for a, p in named + usual if os.path.isdir(p)))


@dataclass(frozen=True)
class Format:
    """A format of one's own: how sure a file is of it (path, first lines to score), and how its lines become tagged rows (as ``adapters.parse_lines``)."""

    name: str
    probe: Callable[[DataFrame], DataFrame]
    parse: Callable[[DataFrame], DataFrame]
    append_only: bool = False


class Registry:
    """The built-in formats and those registered; names are unique and of lower-case letters, digits and hyphens."""

    def __init__(self):
        self.own: dict[str, Format] = {}

    def register(self, form: Format) -> None:
        if not _NAME.fullmatch(form.name):
            raise ValueError(f"a name has lower-case letters, digits and hyphens: {form.name}")
        if form.name in self.own or form.name in adapters.ADAPTERS:
            raise ValueError(f"{form.name} is registered already")
        self.own[form.name] = form

    def names(self) -> list[str]:
        return [*adapters.ADAPTERS, *self.own]

    def get(self, name: str) -> Format | str:
        """A format of one's own, or the name of a built-in one."""
        if name in self.own:
            return self.own[name]
        if name in adapters.ADAPTERS:
            return name
        raise KeyError(f"no such format: {name}")

    def scores(self, first: DataFrame) -> DataFrame:
        """path, adapter, score by every format's probe."""
        out = adapters.probe_scores(first)
        for form in self.own.values():
            out = out.unionByName(form.probe(first).select("path", F.lit(form.name).alias("adapter"), F.col("score").cast("int").alias("score")))
        return out.filter("score > 0")

    def parse(self, lines: DataFrame, files: DataFrame) -> DataFrame:
        """Tagged rows of all files (path, adapter), each by its format."""
        out = adapters.parse_lines(lines, files.filter(~F.col("adapter").isin(list(self.own)) if self.own else F.lit(True)))
        for form in self.own.values():
            out = out.unionByName(form.parse(lines.join(files.filter(F.col("adapter") == form.name), "path")), allowMissingColumns=True)
        return out


def outside(files: DataFrame, own_output: str) -> DataFrame:
    """``files`` (path) that don't lie in our own output folder."""
    folder = own_output.rstrip("/")
    return files.filter((F.col("path") != folder) & ~F.col("path").startswith(folder + "/"))


def read_events(spark, path: str, schema: str) -> DataFrame:
    """A table kept as one JSON object a line; a line that isn't, or doesn't fit, is an error when read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)

"""YAML sources: hermetic corpus and golden set, with strict keys, and the append used when authoring."""

from __future__ import annotations

import hashlib
import os
import subprocess
from datetime import datetime
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession

CHUNK_KEYS = {"uid", "chunk_index", "tenant_id", "area", "path", "text"}
QUESTION_KEYS = {"question", "uid", "chunk_index", "area", "author", "date"}
CHUNKS = "uid string, chunk_index int, tenant_id string, area string, path string, text string"
QUESTIONS = "question string, uid string, chunk_index int, area string, author string, date string"
GROUPS = "name string, area string, min int, max int"


def _load(path: str) -> dict[str, Any]:
    with open(path, encoding="utf-8") as file:
        return yaml.load(file, yaml.BaseLoader) or {}  # noqa: S506 - strings, lists and maps only


def _strict(row: dict[str, Any], allowed: set[str], required: set[str], what: str) -> None:
    if unknown := set(row) - allowed:
        raise ValueError(f"{what}: unknown keys {sorted(unknown)}")
    if absent := sorted(k for k in required if not row.get(k)):
        raise ValueError(f"{what}: missing {absent}")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    data = _load(path)
    _strict(data, {"chunks"}, {"chunks"}, path)
    rows, seen = [], set()
    for i, c in enumerate(data["chunks"]):
        _strict(c, CHUNK_KEYS, {"uid", "tenant_id", "area", "path", "text"}, f"chunk {i}")
        key = (c["uid"], int(c.get("chunk_index", 0)), c["tenant_id"])
        if key[1] < 0 or key in seen:
            raise ValueError(f"chunk {i}: index {key[1]} of {key[0]}")
        seen.add(key)
        rows.append((c["uid"], key[1], c["tenant_id"], c["area"], c["path"], c["text"]))
    return spark.createDataFrame(rows, CHUNKS)


def read_golden(spark: SparkSession, path: str, allow_empty: bool = False) -> tuple[DataFrame, DataFrame, tuple[int, int]]:
    """Questions, coverage groups (one row per area) and the bounds of the total."""
    data = _load(path)
    _strict(data, {"coverage", "questions"}, set(), path)
    questions = data.get("questions") or []
    if not questions and not allow_empty:
        raise ValueError(f"{path}: no questions")
    rows = []
    for i, q in enumerate(questions):
        _strict(q, QUESTION_KEYS, {"question", "uid", "area"}, f"question {i}")
        rows.append((q["question"], q["uid"], int(q["chunk_index"]) if "chunk_index" in q else None, q["area"], q.get("author"), q.get("date")))
    coverage = data.get("coverage") or {}
    _strict(coverage, {"min_total", "max_total", "groups"}, set(), "coverage")
    groups = []
    for g in coverage.get("groups") or []:
        _strict(g, {"name", "areas", "min", "max"}, {"name", "areas"}, "coverage group")
        groups += [(g["name"], a, int(g.get("min", 0)), int(g.get("max", 0))) for a in g["areas"]]
    return spark.createDataFrame(rows, QUESTIONS), spark.createDataFrame(groups, GROUPS), (int(coverage.get("min_total", 0)), int(coverage.get("max_total", 0)))


def append_question(path: str, question: dict[str, Any]) -> None:
    """Append as text, keep the rest of the file byte for byte, and read it back before replacing the file."""
    _strict(question, QUESTION_KEYS, {"question", "uid", "area"}, "question")
    with open(path, encoding="utf-8") as file:
        before = file.read()
    data = yaml.load(before, yaml.BaseLoader) or {}  # noqa: S506
    if list(data)[-1:] != ["questions"]:
        raise ValueError(f"{path}: questions must be the last key")
    last = before.rstrip("\n").rsplit("\n", 1)[-1]
    indent = "" if any(x.startswith("- ") for x in before.splitlines()) and not last.startswith("  - ") and "\n  - " not in before else "  "
    entry = yaml.safe_dump([{k: str(v) if k != "chunk_index" else int(v) for k, v in question.items()}], allow_unicode=True, sort_keys=False)
    after = before + ("" if before.endswith("\n") else "\n") + "".join(indent + line + "\n" for line in entry.splitlines())
    again = yaml.load(after, yaml.BaseLoader)  # noqa: S506
    if again["questions"][:-1] != (data["questions"] or []) or again["questions"][-1]["question"] != question["question"]:
        raise ValueError("the appended entry does not read back")
    temporary = f"{path}.tmp"
    with open(temporary, "w", encoding="utf-8") as file:
        file.write(after)
    os.replace(temporary, path)


def commits(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """The newest commit of a golden file, and identity, committed: when each question first stood in it."""
    folder, name = os.path.split(os.path.abspath(path))

    def git(*args: str) -> str:
        done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, check=False)
        return done.stdout if done.returncode == 0 else ""

    log = [line.split(" ") for line in git("log", "--format=%H %cI", "--", name).splitlines()]
    first: dict[str, datetime] = {}
    for commit, when in reversed(log):
        data = yaml.load(git("show", f"{commit}:./{name}"), yaml.BaseLoader) or {}  # noqa: S506
        for q in data.get("questions") or [] if isinstance(data, dict) else []:
            if isinstance(q, dict) and q.get("question") and q.get("uid"):
                identity = hashlib.sha256(f"{q['question']}\0{q['uid']}".encode()).hexdigest()
                first.setdefault(identity, datetime.fromisoformat(when))
    return (log[0][0] if log else ""), spark.createDataFrame(sorted(first.items()), "identity string, committed timestamp")

"""Numbered states of a folder: what a reader sees changes with one small file that is put in place last.

Data go to folders of their own; then the state that names them is written under a temporary name and renamed to the next number.
A job that dies before the rename leaves the old state in force, and of two writers that race for a number one fails.
"""
from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import SparkSession

from shelfwise.functions.staging import _hadoop_path

STATES = "_states"
_NAME = re.compile(r"(\d{12})\.json")


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of all states, oldest first; none where the folder has no states."""
    system, there = _hadoop_path(spark, f"{folder}/{STATES}")
    if not system.exists(there):
        return []
    names = [_NAME.fullmatch(status.getPath().getName()) for status in system.listStatus(there)]
    return sorted(int(name[1]) for name in names if name)


def read(spark: SparkSession, folder: str, number: int) -> dict:
    system, there = _hadoop_path(spark, f"{folder}/{STATES}/{number:012d}.json")
    stream = system.open(there)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def current(spark: SparkSession, folder: str) -> tuple[int, dict] | None:
    """Number and content of the state in force."""
    found = numbers(spark, folder)
    return (found[-1], read(spark, folder, found[-1])) if found else None


def publish(spark: SparkSession, folder: str, state: dict, after: int | None = None) -> int:
    """Put `state` in force as the number after `after` (default: after the present one); fails if another writer was faster."""
    if after is None:
        after = max(numbers(spark, folder), default=0)
    system, target = _hadoop_path(spark, f"{folder}/{STATES}/{after + 1:012d}.json")
    _, draft = _hadoop_path(spark, f"{folder}/{STATES}/draft-{uuid.uuid4().hex}")
    stream = system.create(draft, False)
    try:
        stream.write(bytearray(json.dumps(state).encode()))
    finally:
        stream.close()
    if system.exists(target) or not system.rename(draft, target):
        system.delete(draft, False)
        raise RuntimeError(f"state {after + 1} of {folder} has been written by another job")
    return after + 1


def forget(spark: SparkSession, folder: str, number: int) -> None:
    system, there = _hadoop_path(spark, f"{folder}/{STATES}/{number:012d}.json")
    system.delete(there, False)

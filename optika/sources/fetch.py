"""Getting sources: selection from a registry, resumable downloads, checkouts, snapshots, archive rewriting."""

from __future__ import annotations

import os
import random
import shutil
import subprocess
import time
import urllib.error
import urllib.request
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from optika.streaming.control import RETRYABLE, backoff_seconds


def select_sources(registry: DataFrame, wanted: str | list[str], name: str = "source", pinned: str = "pinned") -> DataFrame:
    """Sources of a registry: ``all``, ``pinned``, or a list.  Unknown names, and unpinned ones in a list, are errors."""
    if wanted == "all":
        return registry
    if wanted == "pinned":
        return registry.where(F.col(pinned))
    spark = registry.sparkSession
    asked = spark.createDataFrame([(x,) for x in wanted], f"{name} string")
    if unknown := sorted(r[0] for r in asked.join(registry, name, "left_anti").collect()):
        raise ValueError(f"unknown sources: {', '.join(unknown)}")
    out = registry.join(asked, name, "left_semi")
    if loose := sorted(r[name] for r in out.where(~F.coalesce(F.col(pinned), F.lit(False))).select(name).collect()):
        raise ValueError(f"sources without a pinned revision: {', '.join(loose)}")
    return out


def download(url: str, path: str, size: int | None = None, retries: int = 5, wait: Callable[[float], None] = time.sleep) -> str:
    """Downloads to ``path``.  A part that is there already is continued with a Range request, failures that may pass are
    tried again after a growing delay, the size is checked, and the file appears under its name only when whole."""
    if os.path.exists(path) and (size is None or os.path.getsize(path) == size):
        return path
    part = f"{path}.part"
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    for attempt in range(retries + 1):
        try:
            have = os.path.getsize(part) if os.path.exists(part) else 0
            request = urllib.request.Request(url, headers={"Range": f"bytes={have}-"} if have else {})
            with urllib.request.urlopen(request) as answer, open(part, "ab" if answer.status == 206 else "wb") as out:
                shutil.copyfileobj(answer, out, 1 << 20)
            got = os.path.getsize(part)
            if size is not None and got != size:
                if got > size:
                    os.remove(part)
                raise OSError(f"{url}: {got} bytes, {size} expected")
            os.replace(part, path)
            return path
        except urllib.error.HTTPError as e:
            if e.code == 416:  # the part is not one of this file
                os.remove(part)
            elif e.code not in RETRYABLE:
                raise
            error: Exception = e
        except OSError as e:
            error = e
        if attempt < retries:
            wait(backoff_seconds(attempt, jitter=random.random()))
    raise OSError(f"{url}: {retries + 1} attempts failed") from error


def checkout(url: str, revision: str, folder: str) -> str:
    """A git repository at a revision; returns the commit."""
    if not os.path.isdir(os.path.join(folder, ".git")):
        subprocess.run(["git", "clone", "--quiet", url, folder], check=True)
    subprocess.run(["git", "-C", folder, "checkout", "--quiet", revision], check=True)
    return subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], check=True, capture_output=True, text=True).stdout.strip()


def obtain(kind: str, place: str, revision: str, folder: str) -> str:
    """Gets a source by its kind (http, git or files) and returns the revision that it has."""
    if kind == "http":
        download(place, os.path.join(folder, os.path.basename(place)))
        return revision
    if kind == "git":
        return checkout(place, revision, folder)
    if kind == "files":
        if not os.path.isdir(place):
            raise FileNotFoundError(place)
        return revision
    raise ValueError(f"unknown kind of source: {kind}")


def read_snapshot(spark: SparkSession, root: str, config: str | None, split: str, schema: str | None = None) -> DataFrame:
    """A split of a data set that has been downloaded as a folder: files ``[config/]split-*`` or ``[config/]split.*``, Parquet
    or JSON lines by their suffix, with the file's columns read when a plan needs them."""
    base = f"{root}/{config}" if config else root
    jvm = spark._jvm
    for pattern in (f"{base}/{split}-*", f"{base}/{split}.*", f"{base}/data/{split}-*"):
        p = jvm.org.apache.hadoop.fs.Path(pattern)
        found = [s.getPath().toString() for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []]
        if found:
            if found[0].endswith(".parquet"):
                return spark.read.parquet(*found)
            reader = spark.read.option("mode", "FAILFAST")
            return (reader.schema(schema) if schema else reader).json(found)
    raise FileNotFoundError(f"{root}: no split {split}" + (f" of {config}" if config else ""))


def utterances(df: DataFrame, text: str = "text") -> DataFrame:
    """A conversation corpus's utterances: trimmed texts, blank ones dropped."""
    from optika.functions.text import trim_blanks

    return df.withColumn(text, trim_blanks(F.col(text))).where(F.coalesce(F.col(text) != "", F.lit(False)))


def rewrite_archive(path: str, keep: Callable[[str], bool]) -> list[str]:
    """Writes a ZIP file again without the members that ``keep`` refuses; the others keep their bytes, order and
    dates.  The file is replaced at the end.  Returns the names that went."""
    gone, staged = [], f"{path}.staged"
    with zipfile.ZipFile(path) as old, zipfile.ZipFile(staged, "w") as new:
        for info in old.infolist():
            if not keep(info.filename):
                gone.append(info.filename)
                continue
            with old.open(info) as a, new.open(info, "w", force_zip64=True) as b:
                shutil.copyfileobj(a, b, 1 << 20)
    os.replace(staged, path)
    return gone

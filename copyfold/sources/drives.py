"""Mounts, block devices and capacities of a machine, as small tables, and the drive that each source lies on."""

from __future__ import annotations

import json
import os
import subprocess

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyfold.functions.scalars import as_bool
from copyfold.operators.logs import mount_of

MOUNTS = "mount string, device string, fstype string, line int"
NODES = "node int, parent int, top int, name string, device string, mount string, model string, rota string, transport string, fstype string, size bigint"


def mount_rows(text: str) -> list[tuple[str, str, str, int]]:
    """(mount, device, fstype, line) of the lines of a mount table; spaces in mount points are written \\040."""
    rows = []
    for line, entry in enumerate(text.splitlines()):
        parts = entry.split()
        if len(parts) >= 3:
            rows.append((parts[1].replace("\\040", " "), parts[0], parts[2], line))
    return rows


def mounts(spark, path: str = "/proc/mounts") -> DataFrame:
    """The driver's mount table; one that can't be read is empty."""
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            rows = mount_rows(f.read())
    except OSError:
        rows = []
    return spark.createDataFrame(rows, MOUNTS)


def node_rows(listing: str) -> list[tuple]:
    """The nodes of a JSON listing of block devices, each before its children, with the numbers of its parent and its topmost device."""
    try:
        devices = json.loads(listing or "{}").get("blockdevices") or []
    except ValueError:
        return []
    rows: list[tuple] = []
    stack = [(d, None, None) for d in reversed(devices)]
    while stack:
        d, parent, top = stack.pop()
        number = len(rows)
        top = number if top is None else top
        mount = d.get("mountpoint") or next((m for m in d.get("mountpoints") or [] if m), None)
        text = {k: None if d.get(k) is None else str(d[k]) for k in ("name", "path", "model", "rota", "tran", "fstype")}
        size = str(d.get("size") or "0")
        rows.append((number, parent, top, text["name"], text["path"] or f"/dev/{text['name']}", mount, text["model"], text["rota"], text["tran"], text["fstype"], int(size) if size.isdigit() else 0))
        stack += [(c, number, top) for c in reversed(d.get("children") or [])]
    return rows


def block_devices(spark, listing: str | None = None) -> DataFrame:
    """Block devices from a JSON listing, by default that of the driver's machine; none if it can't be had within five seconds."""
    if listing is None:
        try:
            listing = subprocess.run(["lsblk", "-J", "-b", "-o", "NAME,PATH,MODEL,ROTA,TRAN,FSTYPE,SIZE,MOUNTPOINT"], capture_output=True, text=True, timeout=5, check=False).stdout
        except (OSError, subprocess.SubprocessError):
            listing = ""
    return spark.createDataFrame(node_rows(listing), NODES)


def capacity(path: str) -> int:
    """Bytes of the file system that holds a path; 0 if that can't be told."""
    try:
        found = os.statvfs(path)
    except OSError:
        return 0
    return found.f_blocks * found.f_frsize


def drives_of(paths: DataFrame, mounted: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each path of ``paths`` with its drive: mount, device, fstype, model, kind (SSD, HDD or empty), transport, size.

    The node is that at the path's mount point, the last listed of equals, else the first whose device it is. What a node doesn't say, its topmost
    device does. Both tables are a machine's, so they are broadcast.
    """
    found = mount_of(paths, mounted)
    own = nodes.select("node", "top", F.col("device").alias("_device"), F.col("mount").alias("_mount"), "model", "rota", "transport", F.col("fstype").alias("_fstype"), "size")
    by_mount = own.filter("_mount IS NOT NULL").groupBy(F.col("_mount").alias("mount")).agg(F.max_by(F.struct("node", "top", "model", "rota", "transport", "_fstype", "size"), "node").alias("a"))
    by_device = own.groupBy(F.col("_device").alias("device")).agg(F.min_by(F.struct("node", "top", "model", "rota", "transport", "_fstype", "size"), "node").alias("b"))
    rows = found.join(F.broadcast(by_mount), "mount", "left").join(F.broadcast(by_device), "device", "left").withColumn("n", F.coalesce("a", "b"))
    tops = nodes.select(F.col("node").alias("_top"), F.struct("model", "rota", "transport").alias("t"))
    rows = rows.join(F.broadcast(tops), F.col("n.top") == F.col("_top"), "left")

    def first(name: str):
        return F.coalesce(F.nullif(F.trim(f"n.{name}"), F.lit("")), F.trim(f"t.{name}"), F.lit(""))

    rota = F.coalesce("n.rota", "t.rota")
    kind = F.when(rota.isNull(), "").when(as_bool(rota), "HDD").otherwise("SSD")
    return rows.select("path", "mount", "device", F.coalesce(F.nullif("fstype", F.lit("")), F.trim("n._fstype"), F.lit("")).alias("fstype"), first("model").alias("model"), kind.alias("kind"), first("transport").alias("transport"), F.coalesce("n.size", F.lit(0)).alias("size"))

"""Files of an index on any file system that Spark can write to."""

from __future__ import annotations

import base64
import hashlib
import io
import json
import os
import time

import numpy as np
from pyspark.sql import SparkSession

from quillon.errors import AlreadyExists, Busy, Corrupt, IdentityMismatch, NotFound, Unsupported
from quillon.functions.codec import Model, Rotation
from quillon.spec import MAX_SEGMENTS, CodecSpec

VERSION = 1
#: Seconds after which a lock is taken to be left over from a builder that died.
LEASE = 600


class Files:
    """The few operations that a commit consists of; tests replace them to let one fail."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = jvm = spark.sparkContext._jvm
        self._gateway, self._conf = spark.sparkContext._gateway, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self.root = root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._io = jvm.org.apache.hadoop.io.IOUtils
        self._buffer = jvm.java.io.ByteArrayOutputStream

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.at(name)))

    def read(self, name: str) -> str:
        if not self.exists(name):
            raise NotFound(self.at(name))
        stream, out = self._fs.open(self._path(self.at(name))), self._buffer()
        self._io.copyBytes(stream, out, 65_536, True)
        return bytes(out.toByteArray()).decode()

    def write(self, name: str, text: str) -> None:
        stream = self._fs.create(self._path(self.at(name)), True)
        try:
            stream.write(bytearray(text.encode()))
            stream.hsync() if hasattr(stream, "hsync") else stream.flush()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Write a file that must not be there yet."""
        if self._fs.getScheme() == "file":
            path = self.at(name).removeprefix("file:")
            os.makedirs(os.path.dirname(path), exist_ok=True)
            try:
                with os.fdopen(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY), "w") as f:
                    f.write(text)
            except FileExistsError as e:
                raise AlreadyExists(self.at(name)) from e
            return
        try:
            stream = self._fs.create(self._path(self.at(name)), False)
        except Exception as e:
            if self.exists(name):
                raise AlreadyExists(self.at(name)) from e
            raise
        stream.write(bytearray(text.encode()))
        stream.close()

    def replace(self, source: str, target: str) -> None:
        """Move a file over another in one step. A file system that cannot do so keeps the old one beside it, as
        ``<target>.old``, until the new one is in place; readers fall back to that."""
        if self._fs.getScheme() == "file":
            os.replace(self.at(source).removeprefix("file:"), self.at(target).removeprefix("file:"))
        elif not self._rename_over(source, target):
            self._rename_aside(source, target)

    def _rename_over(self, source: str, target: str) -> bool:
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        over = self._gateway.new_array(kind, 1)
        over[0] = kind.OVERWRITE
        a, b = self._path(self.at(source)), self._path(self.at(target))
        try:
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        except Exception:  # no such interface to this file system
            return False
        context.rename(a, b, over)
        return True

    def _rename_aside(self, source: str, target: str) -> None:
        a, b, aside = (self._path(self.at(n)) for n in (source, target, f"{target}.old"))
        if self._fs.exists(b):
            self._fs.delete(aside, False)
            if not self._fs.rename(b, aside):
                raise OSError(f"cannot set {target} aside")
        if not self._fs.rename(a, b):
            raise OSError(f"cannot move {source} to {target}")
        self._fs.delete(aside, False)

    def age(self, name: str) -> float:
        """Seconds since a file was last written; by the clock of this machine."""
        return time.time() - self._fs.getFileStatus(self._path(self.at(name))).getModificationTime() / 1000

    def lock(self, owner: str) -> None:
        """Take the one lock for publishing. A lock older than LEASE is broken: its builder has died."""
        for last in (False, True):
            try:
                return self.create("LOCK", owner)
            except AlreadyExists as e:
                if last or self.age("LOCK") < LEASE:
                    raise Busy(self.root) from e
                self._fs.delete(self._path(self.at("LOCK")), False)

    def unlock(self, owner: str) -> None:
        """Give the lock back, unless another has taken it over."""
        try:
            if self.exists("LOCK") and self.read("LOCK") == owner:
                self._fs.delete(self._path(self.at("LOCK")), False)
        except Exception:  # it expires by itself
            pass

    def names(self, folder: str = "") -> list[str]:
        path = self._path(self.at(folder) if folder else self.root)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(self.at(name)), True)


def pack_container(kind: str, payload: dict) -> str:
    """JSON with its own hash."""
    body = json.dumps(payload, sort_keys=True)
    return json.dumps({"kind": kind, "version": VERSION, "payload": body, "sha256": hashlib.sha256(f"{kind}:{VERSION}:{body}".encode()).hexdigest()})


def unpack_container(kind: str, text: str) -> dict:
    try:
        outer = json.loads(text)
        body, version = outer["payload"], outer["version"]
        right = hashlib.sha256(f"{outer['kind']}:{version}:{body}".encode()).hexdigest() == outer["sha256"]
    except (ValueError, KeyError, TypeError) as e:
        raise Corrupt(f"not a {kind} file") from e
    if not right or set(outer) != {"kind", "version", "payload", "sha256"}:
        raise Corrupt(f"a {kind} file with a wrong hash")
    if version != VERSION:
        raise Unsupported(f"version {version} of a {kind} file")
    if outer["kind"] != kind:
        raise IdentityMismatch(f"a {outer['kind']} file in place of a {kind} file")
    return json.loads(body)


def _pack(a: np.ndarray) -> str:
    out = io.BytesIO()
    np.save(out, a)
    return base64.b64encode(out.getvalue()).decode()


def model_payload(model: Model) -> dict:
    s = model.spec
    return {
        "spec": [s.dim, s.block, s.rounds, s.centers, s.sub, s.centroids], "seed": model.rotation.seed, "rotation": model.rotation.identity,
        "identity": model.identity, "centers": _pack(model.centers), "codebook": _pack(model.codebook), "baseline": model.baseline,
    }


def restore_model(payload: dict) -> Model:
    """A model from its file; the rotation is made anew from its seed and must come out the same."""
    load = lambda t: np.load(io.BytesIO(base64.b64decode(t)))
    spec = CodecSpec(*payload["spec"])
    model = Model(spec, Rotation.of(spec, payload["seed"]), load(payload["centers"]), load(payload["codebook"]), payload["baseline"])
    model.check()
    if model.rotation.identity != payload["rotation"] or model.identity != payload["identity"]:
        raise IdentityMismatch("the model is not the one it says it is")
    return model


def check_segments(segments: list[dict], total: int) -> None:
    """Segments must follow each other from row 0 without gap or overlap and make up the total."""
    if len(segments) > MAX_SEGMENTS:
        raise Corrupt(f"{len(segments)} segments")
    at = 0
    for s in segments:
        if s["first_row"] != at or s["row_count"] < 1:
            raise Corrupt(f"segment {s['segment']} begins at {s['first_row']}, not at {at}")
        at += s["row_count"]
    if at != total:
        raise Corrupt(f"segments hold {at} rows of {total}")

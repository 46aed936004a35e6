"""Where an array's files are: a local folder, or one on a file system that pyarrow reaches (S3, GCS, HDFS, ABFS)."""

from __future__ import annotations

import os
import shutil
import tempfile
from urllib.parse import urlsplit

#: None (all), (start, stop), an offset (from there to the end) or -n (the last n bytes).
ByteSpec = None | int | tuple[int, int]


def resolve_range(spec: ByteSpec, size: int) -> tuple[int, int]:
    """(start, stop) within a file of ``size`` bytes; what lies beyond its end is cut off."""
    match spec:
        case None:
            lo, hi = 0, size
        case bool():
            raise TypeError("a boolean is not a byte range")
        case int():
            lo, hi = (spec, size) if spec >= 0 else (size + spec, size)
        case (int() as lo, int() as hi):
            pass
        case _:
            raise TypeError(f"{spec!r} is not a byte range")
    lo = min(max(0, lo), size)
    return lo, min(max(lo, hi), size)


class Store:
    """Files by key below a root. Files are written whole; one that is not there is None, or FileNotFoundError in ``read``."""

    def __init__(self, root: str, *, read_only: bool = False):
        self.root, self.read_only = str(root).rstrip("/"), read_only

    def get(self, key: str, byte_range: ByteSpec = None) -> bytes | None:
        """A range of a file, cut off at its end; None if there is no such file."""
        size = self.size(key)
        if size is None:
            return None
        lo, hi = resolve_range(byte_range, size)
        return self._read(key, lo, hi - lo) if hi > lo else b""

    def read(self, key: str, offset: int, nbytes: int) -> bytes:
        """Exactly ``nbytes``: a file that ends before raises OSError."""
        data = self._read(key, offset, nbytes) if nbytes else b""
        if len(data) != nbytes:
            raise OSError(f"{self.root}/{key}: {len(data)} of {nbytes} bytes at {offset}")
        return data

    def set(self, key: str, data: bytes) -> None:
        """Write a whole file beside its place and move it there, so that a task that runs again does no harm."""
        self._writable()
        self._write(key, data)

    def clear(self) -> None:
        """Delete everything below the root."""
        self._writable()
        self._clear()

    def _writable(self) -> None:
        if self.read_only:
            raise PermissionError(f"{self.root} is open for reading only")

    def size(self, key: str) -> int | None:
        """Bytes of a file; None if it is not there."""
        sign = self.signature(key)
        return None if sign is None else sign[0]

    def signature(self, key: str) -> tuple | None:
        """What changes when a file is replaced: its size first."""
        raise NotImplementedError


class LocalStore(Store):
    def _at(self, key: str) -> str:
        return os.path.join(self.root.removeprefix("file://"), key)

    def signature(self, key):
        try:
            s = os.stat(self._at(key))
        except (FileNotFoundError, NotADirectoryError):
            return None
        return s.st_size, s.st_mtime_ns, s.st_ino

    def _read(self, key, offset, nbytes):
        with open(self._at(key), "rb") as f:
            f.seek(offset)
            return f.read(nbytes)

    def _write(self, key, data):
        path = self._at(key)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        fd, part = tempfile.mkstemp(dir=os.path.dirname(path), prefix=".part-")
        with os.fdopen(fd, "wb") as f:
            f.write(data)
        os.replace(part, path)

    def _clear(self):
        shutil.rmtree(self._at(""), ignore_errors=True)


class RemoteStore(Store):
    """Any file system that pyarrow opens by URI. Object stores show a file when its stream is closed; others move it."""

    _OBJECTS = ("s3", "gs", "gcs", "abfs", "abfss")

    def _open(self):
        from pyarrow import fs

        if not hasattr(self, "_fs"):
            self._fs, self._path = fs.FileSystem.from_uri(self.root)
        return self._fs

    def __getstate__(self):
        return {"root": self.root, "read_only": self.read_only}

    def _at(self, key: str) -> str:
        return f"{self._path}/{key}"

    def signature(self, key):
        from pyarrow import fs

        info = self._open().get_file_info(self._at(key))
        return (info.size, info.mtime_ns) if info.type == fs.FileType.File else None

    def _read(self, key, offset, nbytes):
        with self._open().open_input_file(self._at(key)) as f:
            return f.read_at(max(0, min(nbytes, f.size() - offset)), offset)

    def _write(self, key, data):
        import uuid

        fs, path = self._open(), self._at(key)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        moved = urlsplit(self.root).scheme not in self._OBJECTS
        to = f"{path}.part-{uuid.uuid4().hex}" if moved else path
        with fs.open_output_stream(to) as f:
            f.write(data)
        if moved:
            fs.move(to, path)

    def _clear(self):
        from pyarrow import fs

        if self._open().get_file_info(self._path).type == fs.FileType.Directory:
            self._fs.delete_dir(self._path)


def open_store(root: str, *, read_only: bool = False) -> Store:
    """The store of a path or URI. An absolute path and ``file://`` are local; executors must see the same folder there."""
    local = urlsplit(str(root)).scheme in ("", "file")
    return (LocalStore if local else RemoteStore)(str(root), read_only=read_only)

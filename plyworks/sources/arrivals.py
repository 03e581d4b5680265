"""Files that arrive in a folder, as a stream for Python data sources."""

from __future__ import annotations

from pyspark.sql import datasource as ds

from .record_files import Place, told_path


class Arrivals(ds.DataSourceStreamReader):
    """Files by time of change and name; the offset is the last of them, so it is small however many there are.

    A file should be whole when it appears (written elsewhere and moved); one that changes is read again. Subclasses say how a file is
    dealt (`parts`) and read (`rows`)."""

    suffixes: tuple[str, ...] = ()

    def __init__(self, options):
        self.place, self.folder = Place(told_path(options)), options["path"]

    def _files(self) -> list[tuple[int, str]]:
        from pyarrow import fs

        files, path = self.place.at(self.folder)
        found = files.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        names = [(f.mtime_ns, f.path) for f in found if f.type == fs.FileType.File and f.path.endswith(self.suffixes)]
        return sorted((t, n) for t, n in names if not any(p.startswith(("_", ".")) for p in n[len(path) :].split("/")))

    def initialOffset(self):
        return {"time": -1, "name": ""}

    def latestOffset(self):
        files = self._files()
        return {"time": files[-1][0], "name": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start, end):
        low, high = (start["time"], start["name"]), (end["time"], end["name"])
        return [p for f in self._files() if low < f <= high for p in self.parts(f[1])] or [None]

    def read(self, partition):
        return self.rows(partition) if partition is not None else iter(())

    def parts(self, name: str) -> list:
        raise NotImplementedError

    def rows(self, partition):
        raise NotImplementedError

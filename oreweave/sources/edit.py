"""Changes to files' bytes: chunks set and taken out, derived fields checked and mended, sizes and offsets made right.

An edit gives new bytes and never touches the sound: `guarded` compares digests of the sound before and after, and gives the
old bytes back where they differ. A repair is made only where the right value follows from data that is there.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from oreweave.sources import walkers

#: Ids whose payload is the sound.
SOUND = ("data", "SSND", "BODY", "mdat", "frames", "audio")


@dataclass
class Node:
    """A chunk of a RIFF or IFF file: bytes, or a form with chunks inside."""

    id: bytes
    data: bytes = b""
    form: bytes = b""
    inside: list[Node] | None = None

    def size(self) -> int:
        return len(self.data) if self.inside is None else 4 + sum(8 + c.size() + c.size() % 2 for c in self.inside)

    def write(self, order: str) -> bytes:
        """Sizes and pads follow from what is inside, from the bottom up."""
        body = self.data if self.inside is None else self.form + b"".join(c.write(order) for c in self.inside)
        return self.id + struct.pack(order + "I", len(body)) + body + b"\0" * (len(body) % 2)


FORMS = (b"RIFF", b"RIFX", b"FORM", b"LIST", b"CAT ")


def tree(data: bytes) -> tuple[Node, str, bytes]:
    """The chunks of a RIFF or IFF file, its byte order, and what follows its end.

    Where no chunk ends at the size that the file states, all of it is taken. A chunk that runs past the end is cut.
    """
    order = ">" if data[:4] in (b"RIFX", b"FORM", b"CAT ") else "<"
    if data[:4] not in FORMS or len(data) < 12:
        raise ValueError("no chunked file")
    (size,) = struct.unpack_from(order + "I", data, 4)
    end, at = min(len(data), 8 + size), 12
    while at + 8 <= end:
        (n,) = struct.unpack_from(order + "I", data, at + 4)
        at += 8 + n + n % 2
    end = end if at in (end, end + 1) else len(data)

    def inside(at: int, end: int, depth: int) -> list[Node]:
        out = []
        while at + 8 <= end:
            (n,) = struct.unpack_from(order + "I", data, at + 4)
            stop = min(end, at + 8 + n)
            if data[at : at + 4] in FORMS and stop - at >= 12 and depth < 32:
                out.append(Node(data[at : at + 4], form=data[at + 8 : at + 12], inside=inside(at + 12, stop, depth + 1)))
            else:
                out.append(Node(data[at : at + 4], data[at + 8 : stop]))
            at += 8 + n + n % 2
        return out

    return Node(data[:4], form=data[8:12], inside=inside(12, end, 0)), order, data[min(len(data), end + end % 2) :]


def resized(data: bytes) -> bytes:
    """All sizes and pad bytes made to fit what is there, up from the innermost chunk; what follows the end stays."""
    root, order, rest = tree(data)
    return root.write(order) + rest


def with_chunk(data: bytes, name: bytes, payload: bytes | None) -> bytes:
    """The chunk replaced where it is, or added at the end; None takes all of its name out."""
    root, order, rest = tree(data)
    old = [c for c in root.inside if c.id == name]
    if payload is None:
        root.inside = [c for c in root.inside if c.id != name]
    elif old:
        old[0].data, old[0].inside = payload, None
    else:
        root.inside.append(Node(name, payload))
    return root.write(order) + rest


def with_info(data: bytes, tags: dict[str, str | None]) -> bytes:
    """A WAVE file's INFO texts changed; None takes one out, and an empty list goes."""
    root, order, rest = tree(data)
    info = next((c for c in root.inside if c.id == b"LIST" and c.form == b"INFO"), None)
    if info is None:
        info = Node(b"LIST", form=b"INFO", inside=[])
        root.inside.append(info)
    for name, value in tags.items():
        key = name.encode("ascii").ljust(4)[:4]
        same = [c for c in info.inside if c.id == key]
        if value is None:
            info.inside = [c for c in info.inside if c.id != key]
        elif same:
            same[0].data = value.encode() + b"\0"
        else:
            info.inside.append(Node(key, value.encode() + b"\0"))
    if not info.inside:
        root.inside.remove(info)
    return root.write(order) + rest


def stripped(data: bytes) -> bytes:
    """Only what a player needs: format, sound, and what tells its length or loops."""
    root, order, _ = tree(data)
    keep = (b"fmt ", b"fact", b"data", b"ds64", b"smpl", b"inst", b"cue ", b"COMM", b"SSND", b"FVER", b"MARK", b"INST", b"VHDR", b"BODY", b"CHAN")
    root.inside = [c for c in root.inside if c.id in keep]
    return root.write(order)


def sound_digest(data: bytes, kind: str) -> str:
    """Of the chunks that hold the sound, in order."""
    h = hashlib.sha256()
    for c in walkers.walk(data, kind):
        if c["id"].rpartition("/")[2] in SOUND:
            start = c["offset"] + (0 if c["id"] in ("frames", "audio") else 8)
            h.update(data[start : start + c["size"] - (8 if c["id"] == "mdat" else 0)])
    return h.hexdigest()


def guarded(data: bytes, kind: str, change: Callable[[bytes], bytes]) -> tuple[bytes, str]:
    """New bytes and `changed`, or the old ones and `same` or `refused: ...`."""
    try:
        new = change(data)
    except (struct.error, ValueError, IndexError) as e:
        return data, f"refused: {e}"
    if new == data:
        return data, "same"
    return (new, "changed") if sound_digest(new, kind) == sound_digest(data, kind) else (data, "refused: the sound would change")


# -- derived fields

Violation = tuple[str, int, int, int, bool]


def violations(data: bytes, kind: str) -> Iterator[Violation]:
    """(field, place, stored, computed, witnessed) of fields that follow from others and don't fit them.

    witnessed: the data that the right value follows from is whole, so it can be written.
    """
    if kind in ("wav", "rifx", "riff", "aiff", "aifc", "8svx", "smus"):
        order = ">" if data[:4] in (b"RIFX", b"FORM") else "<"
        (stored,) = struct.unpack_from(order + "I", data, 4)
        found = [c for c in walkers.walk(data, kind) if "/" not in c["id"]]
        last = max((c["offset"] + 8 + c["size"] + c["size"] % 2 for c in found[1:] if c["id"] != "tail" and not any("claims" in w for w in c["warnings"])), default=12)
        fits = not any("claims" in w for c in found for w in c["warnings"])
        if stored != min(last, len(data)) - 8 and stored + 8 != last:
            yield "form size", 4, stored, min(last, len(data)) - 8, fits
        known = {c["id"]: c for c in found}
        if kind == "wav" and "fmt " in known and known["fmt "]["size"] >= 16:
            at = known["fmt "]["offset"] + 8
            tag, channels, rate, speed, align, bits = struct.unpack_from("<HHIIHH", data, at)
            if tag in (1, 3) and bits % 8 == 0 and channels:
                if align != channels * bits // 8:
                    yield "block align", at + 12, align, channels * bits // 8, True
                if speed != rate * channels * bits // 8:
                    yield "byte rate", at + 8, speed, rate * channels * bits // 8, True
                if "fact" in known and "data" in known and known["fact"]["size"] >= 4 and channels * bits:
                    (frames,) = struct.unpack_from("<I", data, known["fact"]["offset"] + 8)
                    right = known["data"]["size"] // (channels * bits // 8)
                    if frames != right:
                        yield "fact frames", known["fact"]["offset"] + 8, frames, right, fits
        if kind in ("aiff", "aifc") and {"COMM", "SSND"} <= known.keys():
            at = known["COMM"]["offset"] + 8
            channels, frames, bits = struct.unpack_from(">hIh", data, at)
            width = channels * ((bits + 7) // 8)
            if kind == "aiff" and width > 0 and frames != (known["SSND"]["size"] - 8) // width:
                yield "frames", at + 2, frames, (known["SSND"]["size"] - 8) // width, fits
    elif kind == "mp4":
        yield from _chunk_offsets(data)


def repaired(data: bytes, kind: str) -> tuple[bytes, list[str]]:
    """Bytes with every witnessed field as it must be, and the names of those changed."""
    out, done = bytearray(data), []
    order = "<" if kind == "wav" and data[:4] != b"RIFX" else ">"
    for name, at, _, right, witnessed in violations(data, kind):
        if witnessed:
            out[at : at + (2 if name == "block align" else 4)] = struct.pack(order + ("H" if name == "block align" else "I"), right)
            done.append(name)
    return bytes(out), done


# -- MP4

def boxes(data: bytes, path: str) -> list[dict]:
    return [c for c in walkers.walk(data, "mp4") if c["id"].endswith(path)]


def run_chunks(runs: list[tuple[int, int]], count: int) -> list[int]:
    """Samples in each of `count` chunks: a run goes on until the next one's first chunk (numbered from 1)."""
    out = []
    for (first, per), after in zip(runs, [r[0] for r in runs[1:]] + [count + 1], strict=True):
        out += [per] * max(0, min(after, count + 1) - first)
    return out


def chunk_bytes(data: bytes, track: str) -> tuple[list[int], list[int], int] | None:
    """Bytes of each chunk of a track, the stored offsets, and where these stand. None if a table is missing or too short."""
    found = {}
    for name in ("stsc", "stsz", "stco"):
        box = next((c for c in walkers.walk(data, "mp4") if c["id"] == f"{track}/mdia/minf/stbl/{name}"), None)
        if box is None:
            return None
        found[name] = box["offset"]
    (n,) = struct.unpack_from(">I", data, found["stsc"] + 12)
    runs = [struct.unpack_from(">II", data, found["stsc"] + 16 + 12 * i) for i in range(n)]
    each, count = struct.unpack_from(">II", data, found["stsz"] + 12)
    sizes = [each] * count if each else list(struct.unpack_from(f">{count}I", data, found["stsz"] + 20))
    (chunks,) = struct.unpack_from(">I", data, found["stco"] + 12)
    offsets = list(struct.unpack_from(f">{chunks}I", data, found["stco"] + 16))
    per, at, out = run_chunks(runs, chunks), 0, []
    if sum(per) > len(sizes):
        raise ValueError(f"{sum(per)} samples are told, {len(sizes)} are listed")
    for k in per:
        out.append(sum(sizes[at : at + k]))
        at += k
    return out, offsets, found["stco"] + 16


def _chunk_offsets(data: bytes) -> Iterator[Violation]:
    """Offsets of the chunks of a file's only track, laid one after another from the start of its media."""
    tracks = boxes(data, "trak")
    media = [c for c in walkers.walk(data, "mp4") if c["id"] == "mdat"]
    if len(tracks) != 1 or len(media) != 1:
        return
    found = chunk_bytes(data, tracks[0]["id"])
    if found is None:
        return
    sizes, offsets, at = found
    start, end = media[0]["offset"] + 8, media[0]["offset"] + media[0]["size"]
    where = [start + sum(sizes[:i]) for i in range(len(sizes))]
    whole = sum(sizes) <= end - start
    if offsets != where and not (offsets == sorted(offsets) and all(start <= o <= end for o in offsets)):
        for i, (stored, right) in enumerate(zip(offsets, where, strict=True)):
            if stored != right:
                yield "chunk offset", at + 4 * i, stored, right, whole


def media_seconds(data: bytes) -> tuple[float, float] | None:
    """Seconds that the media header states, and those that the sample table adds up to."""
    head, table = (next(iter(boxes(data, name)), None) for name in ("mdhd", "stts"))
    if head is None or table is None:
        return None
    wide = data[head["offset"] + 8] == 1
    scale, stated = struct.unpack_from(">IQ" if wide else ">II", data, head["offset"] + (28 if wide else 20))
    (n,) = struct.unpack_from(">I", data, table["offset"] + 12)
    total = sum(c * d for c, d in (struct.unpack_from(">II", data, table["offset"] + 16 + 8 * i) for i in range(n)))
    return (stated / scale, total / scale) if scale else None


# -- over tables

def checked(files: DataFrame) -> DataFrame:
    """path, field, place, stored, computed, witnessed of files (path, format, content)."""
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, kind, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                try:
                    rows += [(path.as_py(), *v) for v in violations(data.as_py() or b"", kind.as_py())]
                except (struct.error, ValueError, IndexError):
                    continue  # what can't be read at all is the defects' matter
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "field", "place", "stored", "computed", "witnessed"])

    return files.select("path", "format", "content").mapInArrow(run, "path string, field string, place long, stored long, computed long, witnessed boolean")


def changed(files: DataFrame, change: Callable[[bytes, str], bytes]) -> DataFrame:
    """path, content, state of files after a guarded change; change(data, format) runs on the workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, kind, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                name = kind.as_py() or ""
                new, state = guarded(data.as_py() or b"", name, lambda d, name=name: change(d, name))
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([new], pa.binary()), pa.array([state])], ["path", "content", "state"])

    return files.select("path", "format", "content").mapInArrow(run, "path string, content binary, state string")


def mended(files: DataFrame) -> DataFrame:
    return changed(files, lambda data, kind: repaired(data, kind)[0])


def replace_file(spark: SparkSession, path: str, data: bytes, backup: bool = True) -> None:
    """One file of any Hadoop file system, so that there is always a whole one: written beside, read back, then renamed.

    The old one stays as `<path>.bak` unless backup is False. OSError if what is read back differs; the file is then as before.
    """
    jvm = spark.sparkContext._jvm
    target, beside, old = (jvm.org.apache.hadoop.fs.Path(path + end) for end in ("", ".new", ".bak"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(beside, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    stream = fs.open(beside)
    try:
        back = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()
    if back != data:
        fs.delete(beside, False)
        raise OSError(f"{path}: what was written does not read back")
    if fs.exists(target):
        if backup:
            fs.delete(old, False)
            fs.rename(target, old)
        else:
            fs.delete(target, False)
    if not fs.rename(beside, target):
        if backup and fs.exists(old):
            fs.rename(old, target)
        raise OSError(f"{path}: cannot be renamed")

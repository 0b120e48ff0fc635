"""Copying archives into a case, and the arithmetic of progress."""

from __future__ import annotations

import os
import shutil
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import chain, count

#: Bytes copied at a time.
CHUNK = 4 << 20


@dataclass(frozen=True)
class Copy:
    """An archive and its place in the case; ``done`` tells whether it was there already."""

    source: str
    target: str
    size: int
    done: bool


@dataclass(frozen=True)
class Progress:
    """How far a run is: share in percent, units a second, and seconds to go (None if unknown)."""

    percent: float
    rate: float
    remaining: float | None

    def __str__(self) -> str:
        to_go = "--:--:--" if self.remaining is None else clock(self.remaining)
        return f"{self.percent:.1f}%, {self.rate * 60:,.1f} a minute, {to_go} to go"


def clock(seconds: float) -> str:
    """Hours, minutes and seconds; as many hours as there are."""
    minutes, s = divmod(int(seconds), 60)
    return f"{minutes // 60:02d}:{minutes % 60:02d}:{s:02d}"


def progress(done: float, total: float, seconds: float) -> Progress:
    """Nothing done, or nothing left, leaves the time to go unknown; of nothing, nothing is done."""
    rate = done / seconds if seconds > 0 else 0.0
    left = total - done
    return Progress(100.0 * done / total if total > 0 else 0.0, rate, left / rate if rate > 0 and left > 0 else None)


def same_archive(a: str, b: str) -> bool:
    """One file, or two of equal size; archives are too large to be read for comparing."""
    if not (os.path.exists(a) and os.path.exists(b)):
        return False
    return os.path.samefile(a, b) or os.path.getsize(a) == os.path.getsize(b)


def free_place(folder: str, source: str, taken: Iterable[str] = ()) -> str:
    """The archive's own name in a folder, or the first of name-2, name-3 and so on that is free or holds it already."""
    stem, suffix = os.path.splitext(os.path.basename(source))
    held = set(taken)
    names = chain([stem], (f"{stem}-{k}" for k in count(2)))
    return next(p for n in names if (p := os.path.join(folder, n + suffix)) not in held and (not os.path.exists(p) or same_archive(source, p)))


def plan_copies(sources: Iterable[str], folder: str) -> list[Copy]:
    """Where each archive goes. Two sources of one name get two places, also before either is copied."""
    plan: list[Copy] = []
    for source in sources:
        target = free_place(folder, source, [c.target for c in plan if not (c.source == source or same_archive(c.source, source))])
        plan.append(Copy(source, target, os.path.getsize(source), os.path.exists(target)))
    return plan


def copy_archives(sources: Iterable[str], folder: str, tell: Callable[[Progress], None] = lambda _: None) -> list[Copy]:
    """Copy archives that aren't there yet, times and all; a copy takes its name when it is complete."""
    os.makedirs(folder, exist_ok=True)
    if not os.access(folder, os.W_OK):
        raise PermissionError(f"no right to write into {folder}")
    plan = plan_copies(sources, folder)
    total, done, began = sum(c.size for c in plan if not c.done), 0, time.monotonic()
    for c in plan:
        if c.done or os.path.exists(c.target):
            continue
        part = f"{c.target}.part"
        with open(c.source, "rb") as src, open(part, "wb") as dst:
            while block := src.read(CHUNK):
                dst.write(block)
                done += len(block)
                tell(progress(done, total, time.monotonic() - began))
        shutil.copystat(c.source, part)
        os.replace(part, c.target)
    return plan

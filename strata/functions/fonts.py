"""A registry of typefaces: the families that files hold, names that stand for them, and which family a name means."""

from __future__ import annotations

import struct
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.functions.text import family_key


def families_in(raw: bytes) -> list[str]:
    """Family names of an OpenType or TrueType file, the preferred ones first; none where it isn't one."""
    if raw[:4] not in (b"\0\1\0\0", b"OTTO", b"true"):
        return []
    try:
        (n,) = struct.unpack(">H", raw[4:6])
        tables = {raw[at : at + 4]: struct.unpack(">II", raw[at + 8 : at + 16]) for at in range(12, 12 + 16 * n, 16)}
        start, _ = tables[b"name"]
        _, count, texts = struct.unpack(">HHH", raw[start : start + 6])
        found: dict[int, list[str]] = {16: [], 1: []}
        for i in range(count):
            platform, _, _, kind, size, at = struct.unpack(">6H", raw[start + 6 + 12 * i : start + 18 + 12 * i])
            if kind in found:
                text = raw[start + texts + at : start + texts + at + size]
                found[kind].append(text.decode("mac-roman" if platform == 1 else "utf-16-be"))
    except (KeyError, struct.error, UnicodeDecodeError):
        return []
    return _once(found[16] + found[1])


def _once(names: Sequence[str]) -> list[str]:
    """Without names that are there already in another case."""
    out: dict[str, str] = {}
    for name in names:
        out.setdefault(name.lower(), name)
    return list(out.values())


class Fonts:
    """Registered typefaces, in the order they came. It is small and lives on the driver; names are resolved by expressions."""

    def __init__(self):
        self.fonts: list[tuple[list[str], str | None]] = []

    def register(self, families: Sequence[str], hint: str | None = None) -> int:
        """How many families there are; a file without any isn't kept. ``hint`` is another name for the first."""
        families = _once(families)
        if families:
            self.fonts.append((families, (hint or "").strip() or None))
        return len(families)

    def register_bytes(self, raw: bytes, hint: str | None = None) -> int:
        return self.register(families_in(raw), hint)

    def clear(self) -> None:
        self.fonts.clear()

    def __len__(self) -> int:
        return len(self.fonts)

    def resolve(self, name: Column) -> Column:
        """The family that a name means: by hints first, then by families in any case, then by letters and digits alone; or null."""
        key = family_key(name)
        plain = lambda text: "".join(c for c in text if c.isascii() and c.isalnum()).lower()
        hints = [(h, f[0]) for f, h in self.fonts if h]
        every = _once([x for f, _ in self.fonts for x in f])
        rules = [((F.lower(name) == h.lower()) | (key == plain(h)), f) for h, f in hints]
        rules += [(F.lower(name) == f.lower(), f) for f in every] + [(key == plain(f), f) for f in every]
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for hit, family in rules:
            out = out.when(hit, family)
        return out

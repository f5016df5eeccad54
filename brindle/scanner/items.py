"""What extractors produce, and text that keeps its offsets."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Item:
    """A candidate: a named value, a bare one, a header, a credential by its place, or a password field; offsets in code points."""

    kind: str  # assignment, value, header, credential or password
    name: str | None
    assignment_type: str | None
    value: str
    start: int
    end: int
    scope: tuple[str, ...] = ()


def mask(text: str, regions: list[tuple[int, int]]) -> str:
    """The text with everything outside the regions blank, but for line breaks: offsets stay."""
    out, at = [], 0
    for start, end in sorted(regions):
        start = max(start, at)
        if end <= start:
            continue
        out += [_blank(text[at:start]), text[start:end]]
        at = end
    return "".join([*out, _blank(text[at:])])


def unmask(text: str, regions: list[tuple[int, int]]) -> str:
    """The text with the regions blank, but for line breaks."""
    out, at = [], 0
    for start, end in sorted(regions):
        if end > max(start, at):
            out += [text[at : max(start, at)], _blank(text[max(start, at) : end])]
            at = end
    return "".join([*out, text[at:]])


def _blank(text: str) -> str:
    return "\n".join(" " * len(line) for line in text.split("\n"))


def shifted(items: list[Item], by: int) -> list[Item]:
    """Items of a part of a file, with the file's offsets."""
    return [Item(i.kind, i.name, i.assignment_type, i.value, i.start + by, i.end + by, i.scope) for i in items]

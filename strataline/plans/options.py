"""Options of one extraction: parsing, and whether they apply to a kind of source."""

from __future__ import annotations

from strataline.operators.detect import TYPES


class OptionError(ValueError):
    """What is wrong with an option, for the user."""


def parse_options(words: list[str]) -> dict[str, str | int | bool | None]:
    """type, limit, transcribe and work_dir from command-line words."""
    found: dict[str, str | int | bool | None] = {"type": None, "limit": None, "transcribe": False, "work_dir": None}
    rest = iter(words)
    for word in rest:
        name = word.removeprefix("--").replace("-", "_")
        if not word.startswith("--") or name not in found:
            raise OptionError(f"unrecognised argument: {word}")
        if name == "transcribe":
            found[name] = True
            continue
        value = next(rest, "--")
        if value.startswith("--"):
            raise OptionError(f"{word} needs a value" + (f": {', '.join(TYPES)}" if name == "type" else ""))
        if name == "limit" and not (value.isdigit() and int(value) >= 1):
            raise OptionError(f"--limit needs a whole number from 1 on, not {value!r}")
        found[name] = int(value) if name == "limit" else value
    return found


def applicable(kind: str, options: dict) -> dict:
    """The options that a plan of this kind takes; an error for one that it does not."""
    if options.get("limit") is not None and kind != "playlist":
        raise OptionError("--limit applies to playlists and channels only")
    if options.get("transcribe") and kind not in ("youtube", "playlist"):
        raise OptionError("--transcribe applies to videos and playlists only")
    return {k: options[k] for k in ("limit", "transcribe") if options.get(k)}

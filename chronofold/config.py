"""Settings, checked before any plan is built. What a field may be is declared with it; one loop holds all fields to that."""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

#: Recordings that can be read, and caption styles.
VIDEO_ENDINGS = (".mp4", ".mov", ".heic", ".m4v", ".mkv", ".webm", ".avi", ".mts")
CAPTION_STYLES = ("block", "karaoke", "pop")

Exists = Callable[[str], bool]


def may_be(default=dataclasses.MISSING, **rules):
    """A field with rules: above, below (strict), least, most, multiple, among, endings, shape (of each item), file (must exist if given)."""
    return field(default=default, metadata=rules)


def breaches(config, exists: Exists | None = None) -> Iterator[str]:
    """What is wrong with each field, in order of fields. Files are looked for only where exists says how."""
    for f in dataclasses.fields(config):
        value, rule = getattr(config, f.name), f.metadata
        for name, holds, said in (
            ("above", lambda v, r: v > r, "must be above"),
            ("below", lambda v, r: v < r, "must be below"),
            ("least", lambda v, r: v >= r, "must be at least"),
            ("most", lambda v, r: v <= r, "must be at most"),
            ("multiple", lambda v, r: v % r == 0, "must be a multiple of"),
            ("among", lambda v, r: v in r, "must be one of"),
            ("endings", lambda v, r: v.lower().endswith(r), "must end in"),
            ("shape", lambda v, r: all(re.fullmatch(r, x) for x in v), "must all look like"),
        ):
            if name in rule and not holds(value, rule[name]):
                yield f"{f.name} {said} {rule[name]}, is {value!r}"
        if rule.get("file") and value and exists is not None and not exists(value):
            yield f"{f.name} is not there: {value}"
    yield from getattr(config, "together", lambda: ())()


@dataclass(frozen=True)
class RunConfig:
    """One run's settings; make changed copies with ``dataclasses.replace``."""

    source: str = may_be(endings=VIDEO_ENDINGS, file=True)
    least_clip_s: float = may_be(2.0, above=0)
    most_clip_s: float = 60.0
    split_silence_s: float = may_be(2.0, above=0)
    silence_db: float = may_be(-40.0, below=0)
    cut_silence_s: float = 0.8
    pad_s: float = 0.15
    most_clips: int = may_be(60, above=0)
    short_side: int = may_be(1080, least=0, multiple=2)
    zoom: float = may_be(0.12, least=0, most=0.3)
    zoom_transition_s: float = may_be(4.0, above=0)
    zoom_hold_s: float = may_be(0.0, least=0)
    speakers: str = may_be("", file=True)
    persona: str = ""
    signature: str = may_be("", file=True)
    adjustments: str = may_be("", file=True)
    jobs: int = may_be(0, least=0)

    def together(self) -> Iterator[str]:
        if self.most_clip_s < self.least_clip_s:
            yield "most_clip_s is below least_clip_s"
        if bool(self.speakers) != bool(self.persona):
            yield "speakers and persona go together"

    def checked(self, exists: Exists | None = None) -> RunConfig:
        """self, or ValueError with the first breach."""
        for message in breaches(self, exists):
            raise ValueError(message)
        return self


@dataclass(frozen=True)
class PanelConfig:
    """A panel's settings; ``issues`` tells what is wrong with them and raises nothing."""

    subtitle_style: str = may_be("pop", among=CAPTION_STYLES)
    subtitle_size_ratio: float = may_be(0.0726, least=0.02, most=0.15)
    signature_path: str = may_be("", file=True)
    signature_size_ratio: float = may_be(0.52, least=0.2, most=1.0)
    zoom_enabled: bool = True
    zoom_amplitude: float = may_be(0.12, least=0.0, most=0.3)
    zoom_transition_s: float = may_be(4.0, above=0)
    zoom_hold_auto: bool = True
    zoom_hold_s: float = may_be(10.0, least=0)
    schedule_slots: tuple[str, ...] = may_be(("06:00", "13:00", "18:00", "02:00"), shape=r"\d+:\d+")
    youtube_credential_path: str = ""
    youtube_token_path: str = ""

    @staticmethod
    def of(given: dict) -> PanelConfig:
        """Defaults, overridden by the keys that are known."""
        known = {f.name for f in dataclasses.fields(PanelConfig)}
        return PanelConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in known})

    def issues(self, exists: Exists | None = None) -> list[str]:
        return list(breaches(self, exists))

    @property
    def zoom(self) -> float:
        """How far to zoom: not at all if switched off."""
        return self.zoom_amplitude if self.zoom_enabled else 0.0

    def rest_s(self, clip_s: float) -> float:
        """How long the zoom rests in a clip: by its length if automatic (5 s up to 30 s, else 20), else as set."""
        if not self.zoom_hold_auto:
            return self.zoom_hold_s
        return 5.0 if clip_s <= 30 else 20.0

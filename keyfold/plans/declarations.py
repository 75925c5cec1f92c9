"""What a pipe is declared to do, checked when it is declared."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

MAX_KEYS, MAX_BYTES = 512, 256 << 10


class Miss(Enum):
    """What happens to a record without a store row."""

    FORWARD = "forward"
    DROP = "drop"
    QUARANTINE = "quarantine"


@dataclass(frozen=True)
class WindowPipe:
    """A pane is a sixteenth of the window. Lateness is bounded, or judged by watermark and grace."""

    group_path: str
    window_ns: int
    value_path: str | None = None
    clock: str = "event"
    max_late_ns: int | None = None
    watermark_ns: int | None = None
    grace_ns: int = 0
    expire_ns: int | None = None
    limit_keys: int | None = None
    limit_bytes: int | None = None
    average: bool = False

    def __post_init__(self) -> None:
        if self.window_ns < 1:
            raise ValueError("a window must be longer than nothing")
        if self.clock not in ("event", "ingest"):
            raise ValueError("the clock is event or ingest")
        if self.watermark_ns is not None and self.max_late_ns is not None:
            raise ValueError("either a lateness bound or a watermark")
        if self.watermark_ns is not None and self.clock != "event":
            raise ValueError("a watermark needs the event clock")
        if self.grace_ns and self.watermark_ns is None:
            raise ValueError("grace needs a watermark")
        if self.average and self.value_path is None:
            raise ValueError("an average needs a value")
        if self.limit_keys is not None and not 1 <= self.limit_keys <= MAX_KEYS:
            raise ValueError(f"between 1 and {MAX_KEYS} keys")
        if self.limit_bytes is not None and not 1 <= self.limit_bytes <= MAX_BYTES:
            raise ValueError(f"between 1 and {MAX_BYTES} bytes")

    @property
    def pane_ns(self) -> int:
        return max(self.window_ns // 16, 1)

"""What a conversion is asked for."""

from __future__ import annotations

from dataclasses import dataclass

from glyphlake.functions import classify, fonts, tables


@dataclass(frozen=True)
class ConvertOptions:
    """mode: safe or aggressive. threshold: overrides the mode's for ambiguous runs (None: the mode's). auto_match: fonts by family."""

    mode: str = "safe"
    encoding: str = "bijoy"
    unicode_font: str = fonts.DEFAULT
    threshold: float | None = None
    auto_match: bool = False

    @classmethod
    def of(cls, mode: str | None = None, encoding: str | None = None, unicode_font: str | None = None, threshold: float | None = None, auto_match: bool | None = None) -> ConvertOptions:
        """From optional names, which are checked; unknown ones raise ValueError."""
        return cls(classify.mode_of(mode), tables.encoding_of(encoding), fonts.target_font(unicode_font), threshold, bool(auto_match))

    @property
    def bar(self) -> float:
        return classify.THRESHOLDS[self.mode] if self.threshold is None else self.threshold

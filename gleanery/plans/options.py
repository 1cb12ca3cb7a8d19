"""Options of a run, with their bounds."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

PROFILES = ("fast", "balanced", "maximum")
ROUTES = {
    "archive-only": ["archive"], "live-only": ["live"], "fast": ["live", "reader"], "archive-first": ["archive", "live", "reader"],
    "live-first": ["live", "reader", "archive"], "balanced": ["live", "reader", "archive"],
}
BOUNDS = {"concurrency": (1, 12), "retries": (1, 8), "timeout_ms": (3_000, 60_000), "min_chars": (120, 5_000)}


@dataclass(frozen=True)
class Options:
    url_column: str = "url"
    group_column: str | None = "title"
    summary_column: str | None = "summary"
    concurrency: int = 4
    retries: int = 3
    timeout_ms: int = 15_000
    min_chars: int = 300
    respect_robots: bool = True
    use_reader: bool = True
    use_archive: bool = True
    reuse_ai: bool = True
    enable_ai: bool = False
    route: str = "balanced"
    profile: str = "balanced"
    model: str = ""

    def __post_init__(self):
        if not self.url_column:
            raise ValueError("url_column is empty")
        for name, (low, high) in BOUNDS.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be from {low} to {high}")
        if self.route not in ROUTES or self.profile not in PROFILES:
            raise ValueError("no such route or profile")

    def tuned(self) -> Options:
        """With what the profile changes."""
        if self.profile == "fast":
            return replace(self, route="fast" if self.route == "balanced" else self.route, retries=min(self.retries, 2), timeout_ms=min(self.timeout_ms, 12_000), use_archive=self.use_archive and "archive" in self.route)
        if self.profile == "maximum":
            return replace(self, retries=max(self.retries, 4), timeout_ms=max(self.timeout_ms, 20_000), use_reader=True, use_archive=True)
        return self

    def routes(self) -> list[str]:
        """The sources in order, those switched off left out; may be empty."""
        return [r for r in ROUTES[self.route] if (r != "reader" or self.use_reader) and (r != "archive" or self.use_archive)]

    def snapshot(self) -> dict:
        """What of a run may be kept: options only, there are no secrets in them."""
        return asdict(self)

"""List columns: membership flags, set comparison, sizes, and the fixed vocabularies."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Genres, tags and platforms that become 0/1 feature columns.
GENRES = (
    "Action", "Adventure", "Indie", "RPG", "Simulation", "Strategy", "Casual", "Early Access",
    "Massively Multiplayer", "Sports", "Racing",
)
TAGS = (
    "Multiplayer", "Singleplayer", "Co-op", "Online Co-Op", "Open World", "Survival", "Crafting",
    "Building", "Sandbox", "Roguelike", "Roguelite", "Pixel Graphics", "2D", "3D", "Atmospheric",
    "Story Rich", "Difficult", "Procedural Generation", "Horror", "Action RPG",
)
PLATFORMS = ("windows", "mac", "linux")
# Substrings that mark a category.
CATEGORY_MARKS = {
    "has_multiplayer_category": ("Multi-player", "Co-op"),
    "has_controller_support": ("Controller",),
    "has_cloud_saves": ("Cloud",),
}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag_name(prefix: str, item: str) -> str:
    return prefix + item.lower().replace(" ", "_").replace("-", "_")


def flag_columns(items, vocabulary: Iterable[str], prefix: str) -> dict[str, Column]:
    """One 0/1 column per vocabulary entry."""
    return {
        flag_name(prefix, item): F.array_contains(_col(items), F.lit(item)).cast("int")
        for item in vocabulary
    }


def any_contains(items, needles: Iterable[str]) -> Column:
    """Does any list entry contain any of the substrings?"""

    def hit(entry):
        found = F.lit(False)
        for needle in needles:
            found = found | F.contains(entry, F.lit(needle))
        return found

    return F.exists(_col(items), hit)


def same_set(left, right) -> Column:
    """Both lists are non-empty and hold the same values."""
    a, b = _col(left), _col(right)
    return (
        (F.size(a) > 0)
        & (F.size(b) > 0)
        & (F.size(F.array_except(a, b)) == 0)
        & (F.size(F.array_except(b, a)) == 0)
    )


def list_sizes(**lists) -> dict[str, Column]:
    return {name: F.size(_col(items)) for name, items in lists.items()}

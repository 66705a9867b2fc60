"""Where the parts of a document stand, and mistakes with the stretch of text that they are about."""

from __future__ import annotations

#: At the end of a path: the name itself, not what it names.
KEY = "\0key"


class Places:
    """(start, end) in code points of what stands at a path of names and numbers; what is unknown stands where the nearest
    part around it does."""

    def __init__(self, start: int, end: int):
        self.at: dict[tuple, tuple[int, int]] = {(): (start, end)}

    def put(self, path: tuple, start: int, end: int) -> None:
        self.at[path] = (start, end)

    def find(self, path: tuple) -> tuple[int, int]:
        while path not in self.at:
            path = path[:-1]
        return self.at[path]

    def moved(self, by: int) -> Places:
        out = Places(0, 0)
        out.at = {path: (a + by, b + by) for path, (a, b) in self.at.items()}
        return out


class Problems:
    """Mistakes of a document as (message, start, end); `places` and `path` say where what is being looked at stands."""

    __slots__ = ("places", "path", "found")

    def __init__(self, places: Places, path: tuple = (), found: list | None = None):
        self.places, self.path, self.found = places, path, [] if found is None else found

    def add(self, message: str, path: tuple = ()) -> None:
        self.found.append((message, *self.places.find((*self.path, *path))))

    def under(self, path: tuple, places: Places | None = None) -> Problems:
        """The same mistakes, seen from another part of the document."""
        return Problems(places or self.places, path if places else (*self.path, *path), self.found)

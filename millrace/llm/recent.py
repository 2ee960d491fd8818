"""A bounded memory of results by key, for functions whose keys repeat."""

from __future__ import annotations


class Recent:
    """Two generations of at most `limit` keys each: a key that is asked for again is carried into
    the young one, the rest are forgotten when it is full. Results never depend on what is kept."""

    def __init__(self, limit: int):
        self.limit = limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, keys: set[str]) -> list[str]:
        """Keys to compute and put into `young`; all other keys are in it afterwards."""
        if len(self.young) + len(keys) > self.limit:
            self.old, self.young = self.young, {}
        out = []
        for key in keys.difference(self.young):
            value = self.old.get(key)
            if value is None:
                out.append(key)
            else:
                self.young[key] = value
        return out

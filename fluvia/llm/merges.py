"""What merging by rank implies for single tokens and pairs of neighbours; for texts (str) and bytes alike."""

from __future__ import annotations

from typing import TypeVar

T = TypeVar("T", str, bytes)


def merge(data: T, rank: dict[T, float]) -> tuple[list[T], tuple[T, T] | None]:
    """The definition, for short inputs: from single characters on, merge the two neighbours whose union has the
    least rank, leftmost first, until none merges. Returns the parts and the last two that were merged."""
    parts, last = [data[i : i + 1] for i in range(len(data))], None
    while len(parts) > 1:
        found = [(rank[p + q], i) for i, (p, q) in enumerate(zip(parts, parts[1:], strict=False)) if p + q in rank]
        if not found:
            break
        i = min(found)[1]
        last = (parts[i], parts[i + 1])
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts, last


class Merges:
    """Soundness of tokens and compatibility of neighbours, memoised.

    A token is sound if its own characters merge to it. Two sound neighbours are compatible if merging their
    characters together leaves them as they are: taking back their merges, latest first, no union across the border
    may ever have been due before the merge taken back.
    """

    def __init__(self, rank: dict[T, float], most: int = 500_000) -> None:
        self.rank, self.most = rank, most
        self.known: dict[T, tuple[T, T] | None] = {}
        self.pairs: dict[tuple[T, T], bool] = {}

    def halves(self, token: T) -> tuple[T, T] | None:
        """The last merge inside a sound token; None for a single character and for a token that is not sound."""
        if token not in self.known:
            parts, last = merge(token, self.rank)
            self.known[token] = last if len(parts) == 1 else None
        return self.known[token]

    def sound(self, token: T) -> bool:
        return len(token) == 1 or self.halves(token) is not None

    def compatible(self, left: T, right: T) -> bool:
        if (found := self.pairs.get((left, right))) is None:
            if len(self.pairs) >= self.most:
                self.pairs.clear()
            found = self.pairs[left, right] = self.apart(left, right)
        return found

    def apart(self, left: T, right: T) -> bool:
        """Compatibility, worked out."""
        rank, due, strict = self.rank, float("inf"), True
        while True:
            across = rank.get(left + right)
            if across is not None and (across < due or not strict and across == due):
                return False
            made = rank[left] if len(left) > 1 else -1.0, rank[right] if len(right) > 1 else -1.0
            if max(made) < 0:
                return True
            if made[0] > made[1]:  # of equal ranks, the left merge was first
                due, strict, left = made[0], True, self.halves(left)[1]
            else:
                due, strict, right = made[1], False, self.halves(right)[0]

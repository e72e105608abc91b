"""Suffix automata of reference shards."""

from __future__ import annotations


class SuffixAutomaton:
    """The smallest automaton of all substrings of the texts added so far, over bytes."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.size = [-1], [0], 0

    def add(self, text: bytes) -> None:
        """Add a text, one byte at a time; texts do not run into each other."""
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in text:
            q = nxt[last].get(c)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                    continue
                new = len(nxt)
                nxt.append(nxt[q].copy())
                link.append(link[q])
                length.append(length[last] + 1)
                link[q] = new
                p = last
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = new
                    p = link[p]
                last = new
                continue
            new = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and (q := nxt[p].setdefault(c, new)) == new:
                p = link[p]
            if p >= 0:
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(nxt)
                    nxt.append(nxt[q].copy())
                    link.append(link[q])
                    length.append(length[p] + 1)
                    link[q] = link[new] = copy
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = copy
                        p = link[p]
            last = new
        self.size += len(text)

    def matched(self, text: bytes, least: int) -> list[tuple[int, int]]:
        """Matching statistics of text, as the maximal ranges [a, b) of places where a match of at least `least` bytes
        has reached that length: the windows that start at a - least + 1 to b - least occur here."""
        nxt, link, length = self.next, self.link, self.length
        out, state, n, since = [], 0, 0, -1
        for i, c in enumerate(text):
            to = nxt[state].get(c)
            if to is None:
                state = link[state]
                while state >= 0:
                    to = nxt[state].get(c)
                    if to is not None:
                        break
                    state = link[state]
                if state < 0:
                    state, n = 0, 0
                else:
                    n, state = length[state] + 1, to
                if n < least and since >= 0:
                    out.append((since, i))
                    since = -1
            else:
                state = to
                n += 1
            if since < 0 and n >= least:
                since = i
        if since >= 0:
            out.append((since, len(text)))
        return out

"""Suffix automata of bounded depth over the words of a shard, built in bulk.

The suffix links of an automaton form the suffix tree of the reversed text: a node's children extend
it by one word to the left. So the tree is built level by level, by sorting the end positions of a
level by what stands before them; a node is a distinct substring, its endpos count the size of its
group. Nodes along a link whose endpos sets are equal are one state of the automaton.
"""

from __future__ import annotations

import numpy as np


class SuffixAutomaton:
    """All substrings of at most ``depth`` words that end at one of ``ends``.

    ``words`` are numbers of at least 0 and below ``size``, -1 at borders, which no substring crosses;
    it may be several texts one after another. Per depth d from 1: ``count[d]``, endpos counts of the nodes;
    ``end[d]``, one end position of each; ``link[d]``, the node of depth d - 1 without its first word.
    """

    def __init__(self, words: np.ndarray, size: int, ends: np.ndarray, depth: int):
        self.depth = depth
        self.count, self.end, self.link = {}, {}, {}
        self.state: dict[int, np.ndarray] = {}
        ends = ends[words[ends] >= 0]
        node = np.zeros(len(ends), dtype=np.int64)
        for d in range(1, depth + 1):
            at = ends - (d - 1)
            before = np.where(at >= 0, words[np.maximum(at, 0)], -1)
            inside = before >= 0
            ends, node = ends[inside], node[inside]
            _, first, node_here, count = np.unique(node * size + before[inside], return_index=True, return_inverse=True, return_counts=True)
            self.count[d], self.end[d], self.link[d] = count, ends[first], node[first]
            node = node_here
        self._join_states()

    def _join_states(self) -> None:
        """Number the states from the deepest nodes up; a node has its child's state where their endpos sets are equal."""
        made = 0
        for d in range(self.depth, 0, -1):
            state = np.full(len(self.count[d]), -1, dtype=np.int64)
            if d < self.depth:
                same = self.count[d + 1] == self.count[d][self.link[d + 1]]
                state[self.link[d + 1][same]] = self.state[d + 1][same]
            new = state < 0
            state[new] = np.arange(made, made + new.sum())
            made += int(new.sum())
            self.state[d] = state
        self.states = made

    def endpos(self) -> np.ndarray:
        """The endpos count of each state: what all its substrings share."""
        out = np.zeros(self.states, dtype=np.int64)
        for d in range(1, self.depth + 1):
            out[self.state[d]] = self.count[d]
        return out

    def substrings(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """(end position, endpos count) of every distinct substring of d words, by their states."""
        return self.end[d], self.endpos()[self.state[d]]

"""Junctions of one record, base by base, written from the description of the scan and from nothing in the library.

The scan visits the k-mer starts in order, apart from the last two. A flag says whether a gap is open; ``u`` counts the starts
that a gap has used; a miss inside a gap is probed with each base while ``u`` is at most the leniency.
"""

BASES = "ATGC"


def boundary_list(text: str, k: int, leniency: int, has, compat: bool = True):
    """(boundary list, corrections) of ``text``; ``has`` says whether a k-mer is in the set."""
    if len(text) < k + 5:
        return [], []
    now = list(text)
    window = lambda x: "".join(now[x : x + k])
    out, fixes = [], []
    anchored = open_ = False
    last = start = u = none = 0
    votes = dict.fromkeys(BASES, 0)
    for x in range(len(text) - k - 1):
        pos = x + k
        kmer = window(x)
        if has(kmer):
            last = pos
        if not has(kmer) and anchored and not open_:
            open_, start, u, none, votes = True, pos, 1, 0, dict.fromkeys(BASES, 0)
        if not has(kmer) and open_:
            done = False
            if u <= leniency:
                probes = {b: kmer[: k - u] + b + kmer[k - u + 1 :] for b in BASES}
                if compat:
                    kmer = probes["C"]
                fit = [b for b in BASES if has(probes[b])]
                u += 1
                if fit:
                    votes[fit[0]] += 1
                    done = True
                else:
                    none += 1
            if not done and u == leniency + 1:
                for b in BASES:
                    if votes[b] >= 2 * none and votes[b] > sum(votes.values()) - votes[b]:
                        place = pos - (1 + leniency)
                        if now[place] != b:
                            fixes.append((place, now[place], b))
                        now[place] = b
                u += 1
        if has(kmer) and open_:
            if not has(window(x + 1)):
                u += 1
            elif has(window(x + 2)):
                open_ = False
                size = pos - start
                if size > k + 5:
                    back, unfit = dict.fromkeys(BASES, 0), 0
                    for n in range(min(leniency, x)):
                        w = window(x - 1 - n)
                        fit = [b for b in BASES if has(w[:n] + b + w[n + 1 :])]
                        if fit:
                            back[fit[0]] += 1
                        else:
                            unfit += 1
                    out += [start - 1, start]
                    if not any(v >= 2 * unfit for v in back.values()):
                        out += [pos - k - 1, pos - k]
                elif size >= k - leniency - 2:
                    out += [start - 1, pos - k]
        if has(kmer) and not anchored and has(window(x + 1)) and has(window(x + 2)):
            out.append(pos - k + 1)
            anchored = True
    if anchored:
        out.append(last)
    return out, fixes

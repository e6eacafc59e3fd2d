"""The decision ladder over five candidates, unrolled into SQL, as a check of :mod:`quillstone.operators.fusion`.

Candidates 0 to 3 are of handwriting, 4 is of print.
"""

from __future__ import annotations

from quillstone.functions import scores as S
from quillstone.plans import evidence as E

N, HAND = 5, 4


def _clusters() -> str:
    """Stages that number each candidate's cluster by the cluster's first member."""
    pairs = ", ".join(f"{E.sql_dist(f'n{i}', f'n{j}')} AS d{i}{j}" for j in range(N) for i in range(j))
    stages = [f"k0 AS (SELECT *, {pairs}, 0 AS c0 FROM cand)"]
    for j in range(1, N):
        cases = " ".join(f"WHEN c{i} = {i} AND d{i}{j} <= 0.28 THEN {i}" for i in range(j))
        stages.append(f"k{j} AS (SELECT *, CASE {cases} ELSE {j} END AS c{j} FROM k{j - 1})")
    return ",\n".join(stages)


CLUSTERS = f"WITH {E.CANDIDATES},\n{_clusters()}\nSELECT doc_id, line_no, concat_ws(',', {', '.join(f'c{i}' for i in range(N))}) AS clusters FROM k{N - 1}"

_hints = "[" + ", ".join(f"'{x}'" for x in S.DOMAIN_HINTS) + "]"
_hint_cols = ", ".join(f"least(1.0::DOUBLE, 0.25::DOUBLE * len(list_intersect(list_distinct(regexp_extract_all(lower(t{i}), '[a-z0-9]+')), {_hints}))) AS g{i}" for i in range(N))


def _in(i: int, lead: int) -> str:
    return f"(c{i} = {lead})"


def _max(values: list[str]) -> str:
    return f"greatest({', '.join(values)})"


def _lead(lead: int) -> str:
    """A cluster as a struct, with its sort key first; null where no cluster begins there."""
    hand = " + ".join(f"CAST({_in(i, lead)} AS INT)" for i in range(HAND))
    size = " + ".join(f"CAST({_in(i, lead)} AS INT)" for i in range(N))
    hint = _max([f"CASE WHEN {_in(i, lead)} THEN g{i} ELSE -1.0::DOUBLE END" for i in range(N)])
    best = _max([f"CASE WHEN {_in(i, lead)} THEN v{i} ELSE -1.0::DOUBLE END" for i in range(N)])
    hand_best = _max([f"CASE WHEN {_in(i, lead)} THEN v{i} ELSE 0.0::DOUBLE END" for i in range(HAND)])
    scored = ", ".join(f"CASE WHEN {_in(i, lead)} AND ({i} < {HAND} OR ({hand}) = 0) THEN {{'s': v{i} + 0.04::DOUBLE * g{i}, 'o': -{i}}} END" for i in range(N))
    pick = f"-(list_sort(list_filter([{scored}], lambda z: z IS NOT NULL), 'DESC')[1]).o"
    score = f"CASE WHEN {hand_best} <> 0 THEN {hand_best} ELSE {best} END"
    return f"CASE WHEN c{lead} = {lead} THEN {{'h': -({hand}), 'd': -({hint}), 'b': -({best}), 'z': -({size}), 'n': {lead}, 'pick': {pick}, 'score': {score}}} END"


_pool_pairs = [(i, j) for i in range(HAND) for j in range(i + 1, HAND)]
_st_sum = " + ".join(f"CASE WHEN c{i} = top AND c{j} = top THEN 1.0::DOUBLE - d{i}{j} ELSE 0 END" for i, j in _pool_pairs)
_st_n = " + ".join(f"CASE WHEN c{i} = top AND c{j} = top THEN 1 ELSE 0 END" for i, j in _pool_pairs)
_hand_top = " + ".join(f"CAST(c{i} = top AND {i} < {HAND} AS INT)" for i in range(HAND))

FUSE = f"""WITH {E.CANDIDATES},
{_clusters()},
a AS (SELECT *, {_hint_cols} FROM k{N - 1}),
b AS (SELECT *, list_sort(list_filter([{", ".join(_lead(i) for i in range(N))}], lambda z: z IS NOT NULL)) AS cl, script_mode = 'print' AS pr, [t0, t1, t2, t3, t4] AS ts, [v0, v1, v2, v3, v4] AS vs,
  -(list_sort([{", ".join(f"{{'s': v{i}, 'o': -{i}}}" for i in range(HAND))}], 'DESC')[1]).o AS loud FROM a),
c AS (SELECT *, CASE WHEN pr THEN c4 ELSE cl[1].n END AS top, CASE WHEN pr THEN 4 ELSE cl[1].pick END AS best, [d04, d14, d24, d34][loud + 1] AS x FROM b),
d AS (SELECT *, CASE WHEN pr THEN 1.0::DOUBLE ELSE CAST({_hand_top} AS DOUBLE) / {HAND} END AS va, CASE WHEN pr OR ({_st_n}) = 0 THEN 1.0::DOUBLE ELSE ({_st_sum}) / ({_st_n}) END AS st,
  CASE WHEN pr THEN v4 ELSE {_max([f"CASE WHEN c{i} = top THEN v{i} ELSE 0.0::DOUBLE END" for i in range(HAND)])} END AS vis, list_transform(cl, lambda z: exp(z.score - list_max(list_transform(cl, lambda q: q.score)))) AS ex, len(cl) AS n, {_hand_top} AS hn FROM c),
e AS (SELECT *, CASE WHEN n > 1 THEN least(1.0::DOUBLE, -list_sum(list_transform(ex, lambda z: (z / list_sum(ex)) * ln(z / list_sum(ex) + 1e-12::DOUBLE))) / ln(CAST(n AS DOUBLE))) ELSE 0.15::DOUBLE * (1.0::DOUBLE - vis) END AS ent,
  least(1.0::DOUBLE, CASE WHEN n > 1 THEN greatest(1.0::DOUBLE - va, 0.35::DOUBLE * (1.0::DOUBLE - st), 0.4::DOUBLE * x) ELSE greatest(0.12::DOUBLE * (1.0::DOUBLE - st), 0.35::DOUBLE * x) END) AS dis FROM d),
f AS (SELECT *, 0.45::DOUBLE * vis + 0.20::DOUBLE * va + 0.15::DOUBLE * st AS final, 0.35::DOUBLE * ent + 0.35::DOUBLE * dis + 0.20::DOUBLE * 0.3::DOUBLE AS unc, ts[best + 1] AS txt FROM e),
g AS (SELECT *, regexp_matches(txt, '[0-9]|[A-Z][a-z]+|[A-Z0-9]{{4,}}') AS high, (ent > 0.85 AND vis < 0.55) OR (dis > 0.65 AND final < 0.55) AS halt FROM f),
h AS (SELECT *, CASE WHEN high THEN 0.82::DOUBLE ELSE 0.72::DOUBLE END AS mn, CASE WHEN high THEN 0.22::DOUBLE ELSE 0.28::DOUBLE END AS mx FROM g),
i AS (SELECT *, CASE WHEN vis < 0.28 OR (n > 1 AND dis > 0.7 AND final < 0.5) THEN 'ILLEGIBLE'
  WHEN pr AND vis >= greatest(0.60::DOUBLE, mn - 0.08::DOUBLE) AND NOT halt THEN CASE WHEN unc <= mx + 0.08::DOUBLE THEN 'ACCEPTED' ELSE 'REVIEW_REQUIRED' END
  WHEN NOT pr AND NOT halt AND final >= mn AND unc <= mx AND hn >= 1 AND best < {HAND} AND dis <= 0.40 AND x <= 0.35 AND va >= 0.5 THEN 'ACCEPTED'
  WHEN halt OR unc <= 0.62 THEN 'REVIEW_REQUIRED' ELSE 'ILLEGIBLE' END AS s0 FROM h),
j AS (SELECT *, CASE WHEN s0 = 'ACCEPTED' AND ((high AND unc > 0.22) OR (NOT pr AND x > 0.45) OR contains(txt, '?') OR length(txt) - length(replace(txt, '.', '')) > 3
    OR {E.sql_scattered("txt")}) THEN 'REVIEW_REQUIRED' ELSE s0 END AS s1, halt AND vis < 0.28 AS early FROM i),
l AS (SELECT *, list_transform(cl, lambda z: ts[z.pick + 1]) AS al FROM j)
SELECT doc_id, line_no, CASE WHEN early THEN 'ILLEGIBLE' ELSE s1 END AS state, CASE WHEN early OR s1 = 'ILLEGIBLE' THEN '[ILLEGIBLE]' ELSE txt END AS text,
  round(CASE WHEN early THEN 0.1::DOUBLE WHEN s1 = 'REVIEW_REQUIRED' THEN least(final, 0.55::DOUBLE) WHEN s1 = 'ILLEGIBLE' THEN least(final, 0.2::DOUBLE) ELSE final END, 9) AS confidence,
  round(CASE WHEN early THEN 0.95::DOUBLE ELSE unc END, 9) AS uncertainty, round(final, 9) AS final_score, high AS is_high_risk, array_to_string(list_filter(al, lambda z, k: list_position(al, z) = k), '|') AS alternatives
FROM l"""

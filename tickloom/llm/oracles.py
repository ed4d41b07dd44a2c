"""DuckDB SQL of the corpus operators that SQL can express: an independent statement of their results."""

from __future__ import annotations

MIN_SITES = 10
CONTEXT_CHARS, RAISED_BY, LOWERED_BY = 40, 0.1, 0.3
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "nir": 0.8, "ssn": 0.7}
RAISE = {
    "email": "mail email e-mail mailto contact write courriel contacter écrire kontakt schreiben correo contacto escribir",
    "ip": "ip host server address login client adresse serveur connexion rechner anmeldung servidor dirección",
    "card": "card visa mastercard amex credit payment carte paiement karte kreditkarte zahlung tarjeta pago",
    "phone": "phone call tel mobile fax cell téléphone appeler portable telefon anrufen handy teléfono llamar móvil",
    "iban": "iban bank account transfer compte banque virement konto überweisung cuenta banco",
    "nir": "nir social security sécurité sociale assuré vitale",
    "ssn": "ssn social security taxpayer",
}
LOWER = {
    "email": "example noreply exemple beispiel ejemplo",
    "ip": "version release section chapter abschnitt chapitre sección versión",
    "card": "order tracking serial isbn commande bestellung pedido",
    "phone": "isbn serial order commande bestellung pedido",
    "iban": "serial part pièce teil pieza",
    "nir": "serial part order",
    "ssn": "serial part order isbn",
}
EXACT_DEDUP = """WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
  g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON g.t = d.t"""

LINE_DEDUP = f"""WITH s AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS a FROM documents),
  l AS (SELECT doc_id, source, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS pos FROM s WHERE text IS NOT NULL),
  spread AS (SELECT line, min(struct_pack(d := doc_id, p := pos)) AS first FROM l WHERE length(translate(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13), '')) > 0 GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
  m AS (SELECT l.*, spread.line IS NOT NULL AND (first.d <> doc_id OR first.p <> pos) AS gone FROM l LEFT JOIN spread ON spread.line = l.line),
  r AS (SELECT doc_id, coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY pos), '') AS text, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed FROM m GROUP BY doc_id)
SELECT s.doc_id, r.text, coalesce(r.n_lines, 0) AS n_lines, coalesce(r.n_removed, 0) AS n_removed FROM s LEFT JOIN r ON r.doc_id = s.doc_id"""

_TEXTS = "t AS (SELECT doc_id, coalesce(text, '') AS raw, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) AS text FROM documents)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans(kinds: list[tuple[str, str, str]]) -> str:
    """CTEs ending in ``spans``: (doc_id, start, rank, stop, kind, m) of each kind's valid matches."""
    ctes = []
    for rank, (kind, pattern, valid) in enumerate(kinds):
        ctes.append(
            f"""{kind}_a AS (SELECT doc_id, string_split(regexp_replace(text, {_quoted(pattern)}, chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS a FROM t),
  {kind}_p AS (SELECT doc_id, unnest(a) AS part, generate_subscripts(a, 1) AS n FROM {kind}_a WHERE len(a) > 1),
  {kind}_s AS (SELECT doc_id, n, (sum(length(part) - (n > 1)::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT AS start, split_part(part, chr(2), 1) AS m FROM {kind}_p),
  {kind}_m AS (SELECT s.doc_id, s.start, {rank} AS rank, s.start + length(m) AS stop, '{kind}' AS kind, m,
      regexp_matches(substr(t.text, s.start::INT, 1), '[A-Za-z0-9]') AND s.start > 0 AS glued, regexp_matches(substr(t.text, (s.start + length(m) + 1)::INT, 1), '[A-Za-z0-9]') AS tied FROM {kind}_s s JOIN t ON t.doc_id = s.doc_id WHERE n > 1)"""
        )
    union = " UNION ALL ".join(f"SELECT doc_id, start, rank, stop, kind, m FROM {kind}_m WHERE {valid}" for kind, _, valid in kinds)
    return f"{_TEXTS}, " + ", ".join(ctes) + f", spans AS ({union})"


_LISTED = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)"
_DIGITS = "regexp_replace(m, '[ -]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(0, length({_DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN substr({_DIGITS}, (length({_DIGITS}) - i)::INT, 1)::INT
    ELSE (2 * substr({_DIGITS}, (length({_DIGITS}) - i)::INT, 1)::INT) % 10 + (2 * substr({_DIGITS}, (length({_DIGITS}) - i)::INT, 1)::INT) // 10 END)) % 10 = 0"""
_MOVED = "(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4))"
_MOD97 = f"""list_reduce(list_prepend(0, list_transform(range(1, length({_MOVED}) + 1), lambda i: ascii(substr({_MOVED}, i::INT, 1)))),
    lambda a, c: CASE WHEN c < 58 THEN (a * 10 + c - 48) % 97 ELSE (a * 100 + c - 55) % 97 END) = 1"""

_PII = _spans(
    [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_bool_and(list_transform(string_split(m, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(try_cast(ltrim(x, '0') AS INT), 0) <= 255))"),
        ("card", r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 9 AND 15"),
        ("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", f"NOT glued AND {_MOD97}"),
        ("nir", "[12] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}", "NOT glued AND NOT tied AND substr(replace(m, ' ', ''), 1, 13)::BIGINT % 97 = 97 - substr(replace(m, ' ', ''), 14, 2)::INT"),
        ("ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}", "NOT glued AND NOT tied AND substr(m, 1, 3)::INT NOT IN (0, 666) AND substr(m, 1, 3)::INT < 900 AND substr(m, 5, 2)::INT > 0 AND substr(m, 8, 4)::INT > 0"),
    ]
)


def _case(values: dict, wrap=lambda v: v) -> str:
    return "CASE s.kind " + " ".join(f"WHEN '{k}' THEN {wrap(v)}" for k, v in values.items()) + " END"


def _words(text: str) -> str:
    return _quoted(rf"(?:^|[^\pL\pM\pN])(?:{'|'.join(text.split())})(?:[^\pL\pM\pN]|$)")


_KINDS = tuple(BASE_SCORE)
_NEAR = f"lower(substr(t.text, (greatest(start - {CONTEXT_CHARS}, 0) + 1)::INT, (start - greatest(start - {CONTEXT_CHARS}, 0))::INT) || ' ' || substr(t.text, (stop + 1)::INT, {CONTEXT_CHARS}))"
_SCORED = f"""scored AS (SELECT s.*, printf('%.2f', round(least(1.0, {_case(BASE_SCORE)} + CASE WHEN regexp_matches({_NEAR}, {_case(RAISE, _words)}) THEN {RAISED_BY} ELSE 0 END)
    - CASE WHEN regexp_matches({_NEAR}, {_case(LOWER, _words)}) THEN {LOWERED_BY} ELSE 0 END, 2)) AS score FROM spans s JOIN t ON t.doc_id = s.doc_id)"""

PII = f"""WITH {_PII}, {_SCORED},
  g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _KINDS)},
    {_LISTED} FILTER (rank < 4) AS base, {_LISTED} AS spans, string_agg(score, ',' ORDER BY start, rank) AS scores, bool_or(score::DOUBLE >= 0.5) AS found FROM scored GROUP BY doc_id)
SELECT t.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores, coalesce(found, false) AS has_personal_data
FROM t LEFT JOIN g ON g.doc_id = t.doc_id"""

_ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)"
_SECRETS = _spans(
    [
        ("assign", _ASSIGN, f"length(regexp_extract(m, {_quoted(_ASSIGN)}, 1)) >= 6"),
        ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"),
        ("hex", "[0-9a-f]+", "length(m) >= 24"),
        ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "true"),
        ("forge", "gh[pousr]_[A-Za-z0-9]{36,}", "NOT glued"),
        ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", "NOT glued"),
    ]
)

SECRETS = f"""WITH {_SECRETS},
  g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("assign", "access", "hex"))}, {_LISTED} FILTER (rank < 3) AS base, {_LISTED} AS spans FROM spans GROUP BY doc_id)
SELECT t.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in ("assign", "access", "hex"))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t.raw) AS blob_id FROM t LEFT JOIN g ON g.doc_id = t.doc_id"""



def _lloyd(k: int = 40, dims: int = 64, rounds: int = 5) -> str:
    """The rounds of Lloyd's algorithm one after the other, vectors and centroids as one row a component."""
    near = """d{r} AS MATERIALIZED (SELECT rid, c, sum((p.x - m.x) * (p.x - m.x))::BIGINT AS dist FROM p JOIN c{r} m USING (d) GROUP BY rid, c),
  a{r} AS MATERIALIZED (SELECT rid, min(dist) AS dist, arg_min(c, dist * 64 + c) AS c FROM d{r} GROUP BY rid)"""
    move = """s{r} AS MATERIALIZED (SELECT c, d, sum(x)::BIGINT AS s, count(*) AS n FROM p JOIN a{r} USING (rid) GROUP BY c, d),
  c{n} AS MATERIALIZED (SELECT c, d, coalesce((s - ((s % n) + n) % n) // n, m.x) AS x FROM c{r} m LEFT JOIN s{r} USING (c, d))"""
    steps = [near.format(r=0)]
    for r in range(rounds):
        steps += [move.format(r=r, n=r + 1), near.format(r=r + 1)]
    joined = ",\n  ".join(steps)
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = {dims} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
  p AS MATERIALIZED (SELECT rid, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM v),
  f AS MATERIALIZED (SELECT rid, row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c FROM v QUALIFY c < {k}),
  c0 AS MATERIALIZED (SELECT c, d, x FROM f JOIN p USING (rid)),
  {joined},
  t AS (SELECT c, sum(dist)::BIGINT AS cluster_inertia FROM a{rounds} GROUP BY c),
  h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, c::INT AS cluster, dist AS distance, cluster_inertia, (SELECT sum(cluster_inertia)::BIGINT FROM t) AS inertia, centroid_sha256
FROM a{rounds} JOIN v USING (rid) JOIN t USING (c) JOIN h USING (c)"""


ORACLES = {"op13_centroids": _lloyd(), "op1_line_dedup": LINE_DEDUP, "op8_pii": PII, "op9_exact_dedup": EXACT_DEDUP, "op10_secrets": SECRETS}

"""SQL of the queries that SQL can state."""

from __future__ import annotations

from hourloom.llm import merkle, mixing, spelling

HISTORY_HASH = """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256,
  min(doc_id) OVER w <= (SELECT (min(doc_id) + max(doc_id)) // 2 FROM documents) AS in_history
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""

PREFIX_TARGETS = r"""WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))),
sized AS (
  SELECT *, length('<turn>') + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), chr(10), '&#10;')) + 1
    + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) + length('</turn>') + 1 AS chars FROM turns),
placed AS (
  SELECT *, sum(chars) OVER (w ROWS UNBOUNDED PRECEDING) AS up_to, row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS is_last
  FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
said AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS everything,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    CAST(sum(up_to) FILTER (WHERE role = 'assistant' OR is_last) AS BIGINT) AS formatted_chars
  FROM placed GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(everything) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM said"""

_WEIGHTS = f"[{', '.join(map(str, mixing.WEIGHTS))}][(position - 1) % {len(mixing.WEIGHTS)} + 1]"

SAINTE_LAGUE = rf"""WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place, row_number() OVER () AS n FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS position FROM sized GROUP BY source),
weighted AS (SELECT *, {_WEIGHTS} AS weight, {mixing.EPOCHS} * source_size AS ceiling FROM sources),
levels AS (
  SELECT *, (SELECT sum(source_size) FROM sources) - coalesce(sum(ceiling) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight, row_number() OVER w AS fill
  FROM weighted WINDOW w AS (ORDER BY CAST(ceiling AS DOUBLE) / weight, position)),
level AS (SELECT rest, open_weight FROM levels WHERE CAST(rest * weight AS DOUBLE) / CAST(open_weight AS DOUBLE) <= ceiling ORDER BY fill LIMIT 1),
targets AS (
  SELECT *, least(CAST(ceiling AS DOUBLE), CAST((SELECT rest FROM level) * weight AS DOUBLE) / CAST((SELECT open_weight FROM level) AS DOUBLE)) AS target,
    greatest(1, least({mixing.LARGEST_BLOCK}, (SELECT min(source_size) FILTER (WHERE source_size > 0) FROM sources) // {mixing.BLOCK_PARTS})) AS block
  FROM weighted),
blocked AS (SELECT *, CAST(ceil(source_size / block) AS BIGINT) AS n_blocks FROM targets),
plan AS (
  SELECT *, least(CAST(floor(target / block + 0.5) AS BIGINT), {mixing.EPOCHS} * n_blocks) AS quota,
    CASE WHEN n_blocks > 0 THEN CAST('0x' || substr(md5('{mixing.SEED}:source:' || coalesce(source, '')), 1, 8) AS BIGINT) % n_blocks END AS first_block FROM blocked),
placed AS (
  SELECT sized.*, coalesce(CAST(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start
  FROM sized),
joined AS (SELECT p.*, q.* EXCLUDE (source) FROM placed p JOIN plan q ON p.source IS NOT DISTINCT FROM q.source),
runs AS (
  SELECT n, unnest([{{'lo': 0, 'hi': greatest(first_block + quota % n_blocks - n_blocks, 0)}}, {{'lo': first_block, 'hi': least(first_block + quota % n_blocks, n_blocks)}}]) AS run
  FROM joined WHERE size > 0),
pieces AS (
  SELECT n, CAST(sum(least(run.hi * block, start + size) - greatest(run.lo * block, start)) AS BIGINT) AS words, min(greatest(run.lo * block, start)) AS first_word
  FROM runs JOIN joined USING (n) WHERE least(run.hi * block, start + size) > greatest(run.lo * block, start) GROUP BY n),
awards AS (
  SELECT joined.*, words, CASE WHEN size > 0 AND quota >= n_blocks THEN ((start // block - first_block) % n_blocks + n_blocks) % n_blocks
    WHEN words IS NOT NULL THEN quota // n_blocks * n_blocks + ((first_word // block - first_block) % n_blocks + n_blocks) % n_blocks END AS award
  FROM joined LEFT JOIN pieces USING (n)),
ends AS (
  SELECT source, i, CASE WHEN i = {mixing.SHARDS} THEN quota ELSE least(floor(i * target / (block * {mixing.SHARDS}) + 0.5), quota) END AS filled
  FROM plan, (SELECT unnest(range(1, {mixing.SHARDS + 1})) AS i))
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size > 0 THEN quota // n_blocks * size + coalesce(words, 0) ELSE 0 END AS BIGINT) AS taken,
  CASE WHEN award IS NOT NULL THEN CAST((SELECT count(*) FROM ends e WHERE e.source IS NOT DISTINCT FROM a.source AND filled <= award) AS INTEGER) END AS shard
FROM awards a"""


# CRC-32 by bytes: a table of 256 entries made by its rule, and one look-up for each byte of a string's hex.
_CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps
  FROM (SELECT unnest(range(256)) AS i))"""


def _crc(text: str) -> str:
    digit = lambda at: f"instr('0123456789ABCDEF', substr(hex({text}), {at}, 1)) - 1"
    octets = f"list_transform(range(1, length(hex({text})), 2), lambda i: 16 * ({digit('i')}) + {digit('i + 1')})"
    step = "xor(c >> 8, steps[xor(c & 255, o) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, o: {step}), 4294967295)"


ASYMMETRIC_CHUNKS = f"""WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '{spelling.RUN}')), '{spelling.CAPITALS}', '{spelling.SMALL}') AS run
  FROM documents),
counted AS (SELECT id, run, count(*) AS times FROM runs GROUP BY id, run),
found AS (SELECT run, times, {_crc("(id || ':' || run)")} AS h FROM counted, crc_table),
spelled AS (
  SELECT CASE WHEN h % {spelling.SLIP_ONE_IN} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM found),
words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM spelled WHERE length(word) >= {spelling.LEAST_LENGTH} GROUP BY word HAVING sum(times) >= {spelling.LEAST_COUNT}),
shorter AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word FROM shorter a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM shorter a JOIN words b ON a.rest = b.word),
around AS (
  SELECT near.word, count(*) AS n_near, min(struct_pack(order_ := -words.n, word := other)) AS best FROM near JOIN words ON other = words.word GROUP BY near.word),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.order_ >= {spelling.FORM_TIMES} * n THEN best.word END AS form,
    CASE WHEN -best.order_ >= {spelling.FORM_TIMES} * n THEN -best.order_ END AS form_n
  FROM words LEFT JOIN around USING (word)),
walk AS (
  SELECT word, form AS reached, 1 AS steps FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT walk.word, formed.form, steps + 1 FROM walk JOIN formed ON walk.reached = formed.word WHERE formed.form IS NOT NULL),
roots AS (SELECT word, arg_max(reached, steps) AS root FROM walk GROUP BY word)
SELECT formed.word, form, coalesce(root, formed.word) AS root, n, n_near, form_n FROM formed LEFT JOIN roots ON formed.word = roots.word"""

#: Levels that the SQL spells out: trees of up to FANOUT ** LEAF_LEVELS rows, and as many groups as GROUP_LEVELS hold.
LEAF_LEVELS, GROUP_LEVELS = 8, 3


def _levels(name: str, depth: int) -> str:
    """Tables <name>0, <name>1, ... of the nodes of a level with what stands before and after them, over <name>(tree, number, digest, size)."""
    around = "coalesce(string_agg(digest, '') OVER (PARTITION BY tree, number // {f} ORDER BY number ROWS BETWEEN {rows}), '')"
    made = []
    for k in range(depth + 1):
        source = name if k == 0 else f"(SELECT tree, number // {merkle.FANOUT} AS number, sha256(string_agg(digest, '' ORDER BY number)) AS digest, any_value(size) AS size FROM {name}{k - 1} WHERE size > {merkle.FANOUT ** (k - 1)} GROUP BY tree, number // {merkle.FANOUT})"
        sides = [around.format(f=merkle.FANOUT, rows=r) for r in ("UNBOUNDED PRECEDING AND 1 PRECEDING", "1 FOLLOWING AND UNBOUNDED FOLLOWING")]
        made.append(f"{name}{k} AS (SELECT tree, number, digest, size, {sides[0]} AS before, {sides[1]} AS after FROM {source})")
    return ",\n".join(made)


def _climb(name: str, start: str, depth: int) -> str:
    """Tables that carry `proof` and `folded` of the rows of `start` (tree, number, size) up to the top of their tree."""
    made, below = [], start
    for k in range(depth):
        made.append(f"""{name}_at{k} AS (
  SELECT s.* REPLACE (s.proof || coalesce(l.before || l.after, '') AS proof, CASE WHEN l.before IS NULL THEN s.folded ELSE sha256(l.before || s.folded || l.after) END AS folded)
  FROM {below} s LEFT JOIN {name}{k} l ON s.tree = l.tree AND s.number // {merkle.FANOUT**k} = l.number AND s.size > {merkle.FANOUT**k})""")
        below = f"{name}_at{k}"
    return ",\n".join(made)


def _tops(name: str, depth: int) -> str:
    each = [f"SELECT tree, digest FROM {name}{k} WHERE size <= {merkle.FANOUT**k}" + (f" AND size > {merkle.FANOUT ** (k - 1)}" if k else "") for k in range(depth + 1)]
    return " UNION ALL ".join(each)


def _leaf(text: str) -> str:
    said = {**{c: f"CAST({c} AS VARCHAR)" for c in merkle.LEAF_COLUMNS}, "text": text}
    return "sha256(" + " || ".join(f"coalesce(strlen({said[c]}) || ':' || {said[c]}, '-')" for c in merkle.LEAF_COLUMNS) + ")"


_LOWER = f"translate(text, '{spelling.CAPITALS}', '{spelling.SMALL}')"

POINTER_JUMPING = f"""WITH {_CRC_TABLE},
every AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf("text")} AS digest,
    CASE WHEN doc_id IS NOT NULL AND {_crc("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_leaf(_LOWER)} ELSE {_leaf("text")} END AS folded FROM documents, crc_table),
leaf AS (SELECT *, '' AS proof, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS number, count(*) OVER (PARTITION BY tree) AS size FROM every),
{_levels("leaf", LEAF_LEVELS)},
{_climb("leaf", "leaf", LEAF_LEVELS)},
subroots AS ({_tops("leaf", LEAF_LEVELS)}),
lang AS (SELECT tree AS named, 0 AS tree, row_number() OVER (ORDER BY tree) - 1 AS number, digest, count(*) OVER () AS size FROM subroots),
{_levels("lang", GROUP_LEVELS)},
joined AS (
  SELECT doc_id, l.digest AS leaf, g.digest AS subroot, g.tree, g.number, g.size, proof, folded FROM leaf_at{LEAF_LEVELS - 1} l JOIN lang g ON l.tree = g.named),
{_climb("lang", "joined", GROUP_LEVELS)},
root AS ({_tops("lang", GROUP_LEVELS)})
SELECT doc_id, leaf, subroot, root.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root.digest AS verified
FROM lang_at{GROUP_LEVELS - 1}, root"""

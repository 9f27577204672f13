"""The same views as SQL, written independently, for the oracle queries."""

from titrant import constants as K

_KEEP = K.ALPHABET + K.ALPHABET.lower()


def _values(rows, columns: str, name: str) -> str:
    body = ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


_AA = [
    (
        a,
        float(a in K.SIMPLE_POSITIVE) - float(a in K.SIMPLE_NEGATIVE),
        K.PKA["emboss"].get(a, -99.0) if a in K.TITRATING_POSITIVE + K.TITRATING_NEGATIVE else -99.0,
        K.PKA["bjellqvist"].get(a, -99.0) if a in K.TITRATING_POSITIVE + K.TITRATING_NEGATIVE else -99.0,
        K.HYDROPATHY[a],
        K.MAX_ASA[a],
    )
    for a in K.ALPHABET
]

VIEWS = {
    "aa_dim": (
        [],
        _values(_AA, "aa, q, pka_e, pka_b, kd, max_asa", "aa_raw")
        + """, aa_dim AS (SELECT aa, q::INTEGER AS q, kd::DOUBLE AS kd, max_asa::DOUBLE AS max_asa,
          CASE WHEN aa IN ('K','R','H') THEN 1/(1+pow(10::DOUBLE, 7.4-pka_e))
               WHEN aa IN ('D','E','C','Y') THEN -1/(1+pow(10::DOUBLE, pka_e-7.4)) ELSE 0 END::DOUBLE AS qph,
          pka_e::DOUBLE AS pka_e, pka_b::DOUBLE AS pka_b FROM aa_raw)""",
    ),
    "seqs": (
        [],
        f"""seqs AS (SELECT * FROM (SELECT doc_id, source, lang, ((doc_id % 5)*1.5 - 3.0)::DOUBLE AS beta,
          upper(regexp_replace(text, '[^{_KEEP}]', '', 'g')) AS seq FROM documents) WHERE length(seq) > 0)""",
    ),
    "natives": (
        ["seqs"],
        """natives AS (SELECT source, lang, min(doc_id) AS native_id, arg_min(seq, doc_id) AS native_seq
          FROM seqs GROUP BY source, lang)""",
    ),
    "residues": (
        ["seqs"],
        """residues AS (SELECT *, CASE WHEN pos % 4 = 0 THEN 'interface' WHEN pos % 4 = 1 THEN 'core'
          ELSE 'surface' END AS region FROM (SELECT doc_id, source, lang, beta, length(seq) AS n,
          unnest(range(length(seq))) AS pos, unnest(string_split(seq, '')) AS aa FROM seqs))""",
    ),
    "grid": (
        [],
        """grid AS (SELECT l_partkey AS part, l_returnflag AS flag, (l_linenumber-1)::DOUBLE AS beta,
          sum(round(l_extendedprice*100)::BIGINT)::BIGINT / count(*) AS score,
          sum(l_quantity::BIGINT)::BIGINT / count(*) AS conf
          FROM lineitem GROUP BY ALL)""",
    ),
    "resp": (
        [],
        """resp AS (SELECT l_suppkey AS complex, (l_linenumber-1)::DOUBLE AS beta,
          CASE l_returnflag WHEN 'A' THEN 'interface' WHEN 'R' THEN 'core' ELSE 'surface' END AS region,
          sum(l_quantity)::BIGINT AS charge, count(*) AS size FROM lineitem GROUP BY ALL)""",
    ),
    "atoms": (
        [],
        """atom_names AS (SELECT string_split('N CA C O CB NZ NE NH1 NH2 ND1 NE2 OD1 OD2 OE1 OE2 CG CD CE CZ SD HA', ' ') AS a,
            string_split('LYS ARG HIS ASP GLU GLY ALA SER LEU TRP', ' ') AS r),
        atom_rows AS (SELECT vec_id // 50 AS structure, (vec_id % 50) AS slot, r[label+1] AS resname, vec_id,
            embedding AS e, a, unnest(range(21)) AS k FROM embeddings, atom_names),
        atoms_any AS (SELECT structure, slot, resname, vec_id, a[k+1] AS atom,
            CASE k WHEN 18 THEN 'B' WHEN 17 THEN 'A' ELSE '' END AS altloc, a[k+1][1] AS element,
            round(e[1]::DOUBLE*60 + e[3*k+1]::DOUBLE*8, 3)+0.0 AS x, round(e[2]::DOUBLE*60 + e[3*k+2]::DOUBLE*8, 3)+0.0 AS y,
            round(e[3]::DOUBLE*60 + e[3*k+3]::DOUBLE*8, 3)+0.0 AS z FROM atom_rows
            WHERE NOT (r_gly(resname) AND a[k+1] = 'CB')),
        atoms AS (SELECT *, CASE slot % 2 WHEN 0 THEN 'A' ELSE 'B' END AS chain, slot // 2 AS pos FROM atoms_any),
        atoms4 AS (SELECT *, ['A','B','C','D'][slot % 4 + 1] AS chain, slot // 4 AS pos FROM atoms_any),
        heavy AS (SELECT * FROM atoms WHERE element <> 'H' AND altloc IN ('',' ','A')),
        heavy4 AS (SELECT * FROM atoms4 WHERE element <> 'H' AND altloc IN ('',' ','A'))""".replace(
            "r_gly(resname)", "resname = 'GLY'"
        ),
    ),
    "backbones": (
        ["seqs"],
        """backbone_n AS (SELECT doc_id AS structure, CASE WHEN doc_id % 7 = 3 AND length(seq) > 1 THEN length(seq) - 1 ELSE length(seq) END AS n FROM seqs),
        backbone_rows AS (SELECT structure, chain, unnest(range(n)) AS pos FROM backbone_n, (VALUES ('A', 0), ('B', 5)) t(chain, shift)),
        backbones AS (SELECT structure, chain, pos, substr('KADLERGSHW', (structure*3 + pos*7 + CASE chain WHEN 'B' THEN 5 ELSE 0 END) % 10 + 1, 1) AS aa,
            ((pos*5) % 18)::DOUBLE/2 - 4.25 + CASE chain WHEN 'B' THEN 5 ELSE 0 END AS x, ((pos*7) % 11)::DOUBLE/2 - 2.5 AS y, pos*1.5::DOUBLE AS z FROM backbone_rows),
        fits AS (SELECT s.doc_id AS structure, length(s.seq) AS n_letters, b.n AS n_positions,
            CASE WHEN length(s.seq) = b.n THEN 'threaded' ELSE 'refused: length differs' END AS status FROM seqs s JOIN backbone_n b ON s.doc_id = b.structure)""",
    ),
    "polymer": (
        ["atoms"],
        """polymer AS (SELECT structure, chain, pos + 1 AS seqid, vec_id, atom, altloc, element, x, y, z,
            CASE WHEN vec_id % 29 = 0 THEN 'MSE' WHEN vec_id % 31 = 0 THEN 'HOH' WHEN vec_id % 37 = 0 THEN 'SEP' WHEN vec_id % 41 = 0 THEN 'UNK' ELSE resname END AS resname,
            CASE WHEN vec_id % 29 = 0 OR vec_id % 31 = 0 OR vec_id % 37 = 0 THEN 'HETATM' ELSE 'ATOM' END AS record,
            (vec_id % 50)*21 + list_position(a, atom) AS serial FROM atoms, atom_names),
          tagged AS (SELECT *, CASE resname WHEN 'MSE' THEN 'M' WHEN 'SEP' THEN 'S' WHEN 'LYS' THEN 'K' WHEN 'ARG' THEN 'R' WHEN 'HIS' THEN 'H' WHEN 'ASP' THEN 'D' WHEN 'GLU' THEN 'E'
              WHEN 'GLY' THEN 'G' WHEN 'ALA' THEN 'A' WHEN 'SER' THEN 'S' WHEN 'LEU' THEN 'L' WHEN 'TRP' THEN 'W' END AS letter,
              resname = 'HOH' AS skipped, CASE WHEN resname = 'SEP' THEN 'charge-altering residue' WHEN resname = 'UNK' THEN 'unknown residue' END AS problem
            FROM (SELECT structure, chain, seqid, resname, min(serial) AS first_serial FROM polymer GROUP BY ALL)),
          extracted AS (SELECT structure, chain, seqid, resname, skipped, problem, resname = 'MSE' AS modified, first_serial, CASE WHEN NOT skipped AND problem IS NULL THEN letter END AS aa,
              CASE WHEN NOT skipped AND problem IS NULL THEN count(*) FILTER (WHERE NOT skipped AND problem IS NULL) OVER (PARTITION BY structure, chain ORDER BY first_serial) - 1 END AS pos FROM tagged),
          rendered AS (SELECT structure, serial, printf('%-6s%5d %-4s%1s%3s %1s%4d%1s   %8.3f%8.3f%8.3f%6.2f%6.2f          %2s', record, serial, atom, altloc, resname, chain, seqid, ' ', x, y, z, 1.0::DOUBLE, 0.0::DOUBLE, element) AS one,
              printf('%-6s%5d %-4s%1s%3s %1s%4d%1s   %8.3f%8.3f%8.3f%6.2f%6.2f          %2s', record, serial, atom, altloc, resname, chain, seqid, ' ', x + 1, y, z, 1.0::DOUBLE, 0.0::DOUBLE, element) AS two FROM polymer),
          file_lines AS (SELECT structure, 0 AS ord, 'MODEL        1' AS value FROM (SELECT DISTINCT structure FROM polymer) UNION ALL SELECT structure, serial, one FROM rendered
            UNION ALL SELECT structure, 5000, 'ENDMDL' FROM (SELECT DISTINCT structure FROM polymer) UNION ALL SELECT structure, 6000, 'MODEL        2' FROM (SELECT DISTINCT structure FROM polymer)
            UNION ALL SELECT structure, 10000 + serial, two FROM rendered UNION ALL SELECT structure, 20000, 'ENDMDL' FROM (SELECT DISTINCT structure FROM polymer)),
          file_digest AS (SELECT structure, sha256(string_agg(value, chr(10) ORDER BY ord)||chr(10)) AS sha256, sum(length(value)+1)::BIGINT AS bytes FROM file_lines GROUP BY structure)""",
    ),
    "contacts": (
        ["atoms"],
        """contacts AS (SELECT a.structure, a.vec_id AS left_id, b.vec_id AS right_id,
            a.pos AS left_pos, b.pos AS right_pos, a.resname AS left_res, b.resname AS right_res,
            min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))) AS distance
          FROM heavy a JOIN heavy b ON a.structure = b.structure AND a.chain = 'A' AND b.chain = 'B'
          WHERE (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 25.0 GROUP BY ALL)""",
    ),
    "pae": (
        [],
        """pae AS (SELECT vec_id // 16 AS job, (vec_id % 16)*2 + k // 32 AS i, k % 32 AS j, abs(v::DOUBLE)*60 AS pae
          FROM (SELECT vec_id, unnest(range(64)) AS k, unnest(embedding) AS v FROM embeddings))""",
    ),
    "jobs": (
        [],
        """jobs AS (SELECT *, CASE k % 3 WHEN 0 THEN 'gpu' WHEN 1 THEN 'cpu' END AS device FROM (
          SELECT event_id AS key, user_id AS complex, ts, ((event_id % 5)*1.5 - 3.0)::DOUBLE AS beta,
          event_type AS kind, event_type = 'error' AS failed, value AS wall,
          json_extract(props, '$.k')::INTEGER AS k, 50 + (user_id*37) % 1200 AS residues FROM events))""",
    ),
    "folded": (
        [],
        """folded AS (SELECT l.doc_id, l.quality = 1 AS folded, d.n_chars/1000.0::DOUBLE AS rmsd
          FROM labels l JOIN documents d USING (doc_id))""",
    ),
    "raw_designs": (
        [],
        """raw_designs AS (SELECT o_orderkey AS row_id,
          CASE o_orderkey % 11 WHEN 0 THEN '' WHEN 1 THEN 'X'||substr(md5(o_custkey::VARCHAR),1,3) WHEN 2 THEN ' n/a '
            ELSE (o_custkey % 9 + 1)::VARCHAR||substr(md5(o_custkey::VARCHAR),1,3) END AS pdb_id,
          CASE o_custkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'A,B' WHEN 2 THEN 'A,A' WHEN 3 THEN ' A , C' ELSE 'A,,B' END AS designed_chain,
          CASE o_orderkey % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'D' WHEN 2 THEN 'E-F' ELSE 'A' END AS fixed_chain,
          CASE o_orderkey % 6 WHEN 0 THEN '0.0' WHEN 1 THEN '-1.5' WHEN 2 THEN 'nan' WHEN 3 THEN 'inf' WHEN 4 THEN 'abc' ELSE ' 3 ' END AS beta,
          CASE o_orderkey % 7 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '-1' WHEN 3 THEN '1.5' WHEN 4 THEN '3.0' WHEN 5 THEN '2' ELSE '+4' END AS replicate,
          CASE o_orderkey % 8 WHEN 0 THEN t||'X' WHEN 1 THEN lower(t) WHEN 2 THEN '' ELSE t END AS sequence,
          CASE WHEN o_orderpriority = '5-LOW' THEN 'N/A' ELSE (o_orderkey % 41 - 20)::VARCHAR END AS net_charge_reported
          FROM (SELECT *, translate(md5(o_orderkey::VARCHAR), '0123456789abcdef', 'ACDEFGHIKLMNPQRS') AS t FROM orders))""",
    ),
    "designs": (
        [],
        """designs AS (SELECT o_orderkey AS row_id, '1'||lpad(upper(to_base(o_custkey, 36)),3,'0') AS pdb_id,
          ['A','B','C'][o_custkey % 3 + 1] AS designed, CASE WHEN o_custkey % 7 = 0 THEN ['A','B','C'][o_custkey % 3 + 1] ELSE 'D' END AS fixed,
          ((o_orderkey % 5)*1.5 - 3.0)::DOUBLE AS beta, CASE WHEN o_orderstatus='F' THEN 0 ELSE 1 END AS replicate,
          repeat('A', 30 + CASE WHEN o_orderpriority='1-URGENT' THEN (o_custkey % 2)::INTEGER ELSE 0 END) AS sequence FROM orders)""",
    ),
    "raw_test_set": (
        [],
        """raw_test_set AS (SELECT c_custkey AS row_id, CASE WHEN c_custkey % 50 = 0 THEN '1AAA' ELSE '1'||lpad(upper(to_base(c_custkey,36)),3,'0') END AS pdb_id,
          CASE WHEN c_custkey % 20 = 0 THEN ['A','B','C'] WHEN c_custkey % 3 = 0 THEN ['A','D'] ELSE ['B','D'] END AS chains,
          c_mktsegment||'-'||(c_custkey // 10)::VARCHAR AS cluster, CASE WHEN c_nationkey < 3 THEN 'train' ELSE 'test' END AS split, c_nationkey AS nation FROM customer)""",
    ),
}

_ORDER = list(VIEWS)


def sql(views: str, body: str) -> str:
    """`body` behind the named views and whatever they are built from."""
    wanted: set[str] = set()

    def need(name: str) -> None:
        for parent in VIEWS[name][0]:
            need(parent)
        wanted.add(name)

    for name in views.split():
        need(name)
    texts = [VIEWS[n][1] for n in _ORDER if n in wanted]
    body = body.strip()
    if body.upper().startswith("WITH "):
        texts.append(body[5:])
        return "WITH " + ", ".join(texts)
    return "WITH " + ", ".join(texts) + " " + body if texts else body


def mixed_sql(x: str, out: str) -> str:
    """Select items that end in column `out`: the draw hash of the number `x`."""
    return (f"({x}) * 1103515245 % 2147483647 AS {out}_1, xor({out}_1, {out}_1 >> 15) AS {out}_2, "
            f"{out}_2 * 1812433253 % 2147483647 AS {out}_3, xor({out}_3, {out}_3 >> 13) AS {out}")


def hashed_draws_sql(slots: str, out: str, tag: str, sel: str, n: int, extra: str = "") -> str:
    """CTEs that end in `out`: (groups, slot, n, rep, h) for every slot and replicate."""
    return f"""{out}_keyed AS (SELECT {sel}slot, n{extra}, {mixed_sql(f"slot + ('0x'||substr(md5({tag}),1,7))::BIGINT", 'hs')} FROM {slots}),
    {out}_reps AS (SELECT r AS rep, {mixed_sql('r + 1000003', 'hr')} FROM range({n}) t(r)),
    {out} AS (SELECT {sel}slot, n{extra}, rep, {mixed_sql('hs + hr', 'h')} FROM {out}_keyed, {out}_reps)"""


def resample_sql(units: str, groups: str, value: str, unit: str, statistic: str = "avg", n: int = 10_000, seed: int = 0) -> str:
    """CTEs slots, draws, replicates and intervals over a table of one value per unit."""
    g = [c.strip() for c in groups.split(",") if c.strip()]
    part = f"PARTITION BY {', '.join(g)}" if g else ""
    sel = "".join(f"{c}, " for c in g)
    tag = "||'|'||".join([f"'{seed}'"] + [f"{c}::VARCHAR" for c in g])
    using = "".join(f"v.{c} = d.{c} AND " for c in g)
    dsel = "".join(f"d.{c}, " for c in g)
    group_by = f"GROUP BY {', '.join(g)}" if g else ""
    join = f"USING ({', '.join(g)})" if g else "ON true"
    return f"""slots AS (SELECT {sel}{value} AS v, count(*) OVER ({part}) AS n,
      row_number() OVER ({part} ORDER BY md5({tag}||'|'||({unit})::VARCHAR)) - 1 AS slot FROM {units}),
    {hashed_draws_sql('slots', 'draws', tag, sel, n)},
    replicates AS (SELECT {dsel}d.rep, {statistic}(v.v) AS stat FROM draws d JOIN slots v ON {using}v.slot = d.h % d.n
      GROUP BY {dsel}d.rep),
    spread AS (SELECT {sel}quantile_cont(stat, 0.025) AS low, quantile_cont(stat, 0.975) AS high FROM replicates {group_by}),
    points AS (SELECT {sel}{statistic}(v) AS estimate, count(*) AS n FROM slots {group_by}),
    intervals AS (SELECT {sel}round(estimate,6)+0.0 AS estimate, round(low,6)+0.0 AS low, round(high,6)+0.0 AS high, n,
      (low > 0 OR high < 0) AS excludes_zero FROM points JOIN spread {join})"""

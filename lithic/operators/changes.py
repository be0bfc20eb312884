"""Freshness, incremental classification, conflicts, recovery and transactions, as relations over snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithic.operators.graphs import stored
from lithic.operators.windows import common_ends
from lithic.plans.catalogue import both, query
from lithic.plans.dialect import DUCK, SPARK
from lithic.sources.relations import Relations, relation, run, with_ctes

# The order in which a conflict is told. base, current: hashes; sym: whether a symbol is meant.
CONFLICT = """case when base_file is null then 'NO_BASE' when sym and cur_body is null then 'SYMBOL_DELETED' when base_truncated and not sym then 'CLEAN'
    when base_file = cur_file then case when not sym then 'CLEAN' when base_body is not null and base_body = cur_body then 'CLEAN' when base_body is null then 'CLEAN' else 'SYMBOL_CHANGED' end
    when not sym then 'FILE_CHANGED' when base_body = cur_body then 'FILE_CHANGED_SYMBOL_STABLE' when base_sig is not null and cur_sig is not null and base_sig <> cur_sig then 'SYMBOL_SIGNATURE_CHANGED' else 'SYMBOL_CHANGED' end"""
MATRIX = [
    (1, None, None, None, False, "f1", "b1", "s1", True),
    (2, "f1", "b1", "s1", False, "f1", None, None, True),
    (3, "f1", None, None, True, "f2", None, None, False),
    (4, "f1", None, None, False, "f1", None, None, False),
    (5, "f1", "b1", "s1", False, "f1", "b1", "s1", True),
    (6, "f1", None, None, False, "f1", "b1", "s1", True),
    (7, "f1", "b1", "s1", False, "f1", "b2", "s1", True),
    (8, "f1", None, None, False, "f2", None, None, False),
    (9, "f1", "b1", "s1", False, "f2", "b1", "s1", True),
    (10, "f1", "b1", "s1", False, "f2", "b2", "s2", True),
    (11, "f1", "b1", "s1", False, "f2", "b2", "s1", True),
]


def _policy(x: str) -> str:
    return f"case {x} when 'CLEAN' then 'allow' when 'FILE_CHANGED_SYMBOL_STABLE' then 'allow_warn' else 'reject' end"


@both("mut01_conflict", "before", "after", "symbols")
def _(d):
    # a file's first function: its signature is its first line, its body the lines it reaches over; every other file is meant whole
    cols = "i, base_file, base_body, base_sig, base_truncated, cur_file, cur_body, cur_sig, sym"
    first = "select file_id, name, start_line, end_line from (select s.*, row_number() over (partition by file_id order by start_line, id) as rn from symbols s where type = 'function') x where rn = 1"
    lines = lambda x: d.split(x, chr(92) + "n")
    body = lambda x: d.sha(d.join(d.slice(lines(x), "cast(f.start_line as int)", "cast(f.end_line - f.start_line + 1 as int)"), " "))
    sig = lambda x: d.item(lines(x), "f.start_line")
    named = lambda x, y: f"case when f.name is not null and instr({sig(x)}, f.name) = 1 then {y} end"
    snap = f"select b.file_id + 1000 as i, {d.sha('b.content')} as base_file, {named('b.content', body('b.content'))} as base_body, {named('b.content', d.sha(sig('b.content')))} as base_sig, length(b.content) > 16000 as base_truncated, {d.sha('a.content')} as cur_file, {named('a.content', body('a.content'))} as cur_body, {named('a.content', d.sha(sig('a.content')))} as cur_sig, f.name is not null as sym from before b left join after a on a.file_id = b.file_id left join ({first}) f on f.file_id = b.file_id"
    return f"select i, class, {_policy('class')} as policy from (select i, {CONFLICT} as class from (select {cols} from {d.table(cols, MATRIX)} m union all {snap}) x) y"


@both("mut06_recovery", "before", "after")
def _(d):
    # three hashes tell what became of a staged write
    return f"""select path, case when disk = backup then 'abandoned' when disk = new then 'committed' when disk is null then 'orphan' else 'needs_review' end as outcome from (
        select b.path, {d.sha('b.content')} as backup, {d.sha("concat(b.content, ' edited')")} as new, {d.sha("case when b.file_id % 21 = 0 then a.content || '?' else a.content end")} as disk from before b left join after a on a.file_id = b.file_id) x"""


@both("mut06_txn_recovery", "before", "after")
def _(d):
    return f"""select dir, n, case when n_disk = 0 then 'needs_review' when external > 0 then 'needs_review' when landed = 0 then 'abandoned' else 'committed_recovered' end as outcome from (
        select dir, count(*) as n, count(disk) as n_disk, cast(count_if(disk = new) as bigint) as landed, cast(count_if(disk <> new and disk <> backup) as bigint) as external from (
        select {d.extract('b.path', '^([^/]*)')} as dir, {d.sha('b.content')} as backup, {d.sha("concat(b.content, ' edited')")} as new, {d.sha("case when b.file_id % 49 = 0 then a.content || '?' else a.content end")} as disk from before b left join after a on a.file_id = b.file_id) x group by dir) y"""


@both("mut07_edit_status", "files")
def _(d):
    # every edit is matched against the original; then ambiguity, overlap, and what a partial run applies
    edits = [(1, "src1/en/1.txt", "The"), (2, "src2/fr/2.txt", "zzzz"), (3, "src3/en/3.txt", ""), (4, "src4/en/4.txt", "It thtiing")]
    n = "case when old = '' then 0 else cast((length(content) - length(replace(content, old, ''))) / greatest(length(old), 1) as bigint) end"
    return f"select i, path, n, case when old = '' then 'invalid' when n = 0 then 'not_found' when n > 1 then 'ambiguous' else 'matched' end as status from (select e.i, e.path, e.old, {n} as n from (select i, path, old from {d.table('i, path, old', edits)} v union all select file_id + 100, path, substr(content, 1, 12) from files) e join files f on f.path = e.path) x"


@both("mut09_min_diff", "before", "after")
def _(d):
    # what is left between the equal ends is the change, told as a hunk's head
    text = lambda x: f"cast({x} as varchar(20))"
    return f"""select file_id, greatest(removed, added) as lines_changed, concat('@@ -', {text('prefix + 1')}, ',', {text('removed')}, ' +', {text('prefix + 1')}, ',', {text('added')}, ' @@') as head
        from (select file_id, prefix, n_old - prefix - suffix as removed, n_new - prefix - suffix as added from {common_ends(d)} e) x"""


@both("stm02_change_sync", "before", "after")
def _(d):
    return "select coalesce(a.path, b.path) as path, case when a.path is null then 'delete' else 'extract' end as action from before b full outer join after a on a.file_id = b.file_id where a.path is null or b.path is null or a.content <> b.content"


@both("stm03_freshness", "before", "after")
def _(d):
    # times are rounded half up before they are compared
    return "select b.path, floor(a.mtime + 0.5) <> floor(b.mtime + 0.5) as stale from before b join after a on a.file_id = b.file_id"


@both("stm04_classify_changes", "before", "after")
def _(d):
    return """select coalesce(b.path, a.path) as path, case when b.path is null then 'new' when a.path is null then 'deleted' when b.state <> 'dirty' and floor(a.mtime + 0.5) = floor(b.mtime + 0.5) then 'unchanged' when length(a.content) > 1048576 then 'too_large' else 'changed' end as state from before b full outer join after a on a.file_id = b.file_id"""


@both("stm05_mid_parse_change", "before", "after")
def _(d):
    return "select b.path, case when a.mtime - b.mtime > 1 then 'dirty' else 'fresh' end as state from before b join after a on a.file_id = b.file_id"


@both("stm06_extractor_version", "before")
def _(d):
    stored = [("extractor_version", "3")]
    return f"select path, case when m.v <> '4' then 'dirty' else state end as state from before cross join {d.table('k, v', stored)} m"


@both("stm07_mark_dirty", "before")
def _(d):
    # one file, by its path; or all of them
    return "select path, case when path = 'src5/en/5.txt' or file_id = 5 then 'dirty' else state end as one, 'dirty' as forced from before"


@both("stm08_rebind_unresolved", "refs", "symbols", "before", "after")
def _(d):
    # after a change only what names of changed, new or gone files' symbols is resolved anew, and doing it again changes
    # nothing; trees.refresh does it on an index
    return """with moved as (select coalesce(a.file_id, b.file_id) as file_id from after a full outer join before b on b.file_id = a.file_id where a.file_id is null or b.file_id is null or a.content <> b.content),
        names as (select distinct s.name from symbols s join moved m on m.file_id = s.file_id), there as (select s.name, min(s.id) as id from symbols s join after a on a.file_id = s.file_id group by s.name)
        select r.path, r.target_name, t.id as bound, count(*) as n from refs r join names n on n.name = r.target_name left join there t on t.name = r.target_name where r.kind = 'call' group by r.path, r.target_name, t.id"""


@both("stm15_map_staleness", "before", "after")
def _(d):
    return "select max(a.mtime) as newest_disk, max(b.mtime) as newest_index, max(floor(a.mtime)) > max(floor(b.mtime)) as stale from before b full outer join after a on a.file_id = b.file_id"


@both("snk02_upsert_files", "before", "after")
def _(d):
    return f"select b.path, {d.sha('b.content')} as hash from before b where not exists (select 1 from after a where a.file_id = b.file_id) union all select a.path, {d.sha('a.content')} from after a"


@both("snk03_delete_vanished", "before", "after")
def _(d):
    return "select b.path from before b where exists (select 1 from after a where a.file_id = b.file_id)"


@both("snk01_bulk_insert", "symbols")
def _(d):
    # rows go out by file, so that a file's rows are replaced together; 180 rows made one statement
    return "select bucket, count(*) as n, count(distinct file_id) as n_files, cast(ceil(count(*) / 180.0) as bigint) as statements from (select file_id % 16 as bucket, file_id from symbols) s group by bucket"


@both("snk04_log_rotation", "usage")
def _(d):
    # a session's log is rotated by size, and the last three generations stay
    written = "select session, event_id, cast(floor((sum(length(tool) + length(props) + 40) over (partition by session order by event_id) - 1) / 400) as bigint) as generation from usage"
    return f"select session, event_id, last - generation as age, last - generation < 3 as kept from (select w.*, max(generation) over (partition by session) as last from ({written}) w) x"


@both("snk05_rules_text", "files")
def _(d):
    return "select dir, concat('# ', dir, ': ', cast(count(*) as varchar(20)), ' files, ', cast(count(distinct lang) as varchar(20)), ' languages, longest ', cast(max(size) as varchar(20))) as text from files group by dir"


@both("snk07_metadata", "files", "symbols")
def _(d):
    return "select 'files' as relation, count(*) as n, max(file_id) as last_id from files union all select 'symbols', count(*), max(id) from symbols"




@both("mut12_lock_claims", "usage")
def _(d):
    # a claim against the last one on the same file: one's own token holds on, a holder that was not heard of for 30 s
    # loses the lock, and else a claim waits for up to 2 s; only the holder's token releases
    claims = "select event_id, session % 7 as file_id, session as token, event_id * 1000 as at_ms, status <> 'ok' as released from usage"
    held = "select c.*, lag(token) over w as holder, lag(at_ms) over w as heard, lag(released) over w as was_released from (" + claims + ") c window w as (partition by file_id order by at_ms, event_id)"
    return f"select event_id, file_id, case when holder is null or was_released then 'free' when holder = token then 'held' when at_ms - heard > 30000 then 'stale_takeover' when at_ms - heard > 28000 then 'takeover_while_waiting' else 'timeout' end as outcome, coalesce(holder = token, false) as may_release from ({held}) x"


@both("stm14_circuit_breaker", "usage")
def _(d):
    # three failures on end open the circuit; a success closes it
    return """select event_id, tool, failures, failures >= 3 as opened from (select event_id, tool, cast(sum(case when status = 'ok' then 0 else 1 end) over (partition by tool, run order by event_id rows between unbounded preceding and current row) as bigint) as failures
        from (select event_id, tool, status, sum(case when status = 'ok' then 1 else 0 end) over (partition by tool order by event_id rows between unbounded preceding and current row) as run from (select event_id, case when session % 3 = 0 then 'parse' else tool end as tool, status from usage) u) x) y"""


# Edits of files: what was asked for against what the files hold.
def placed(d) -> str:
    """(file_id, path, seq, old, new, content, n, pos): each edit with how often and where its old text stands."""
    n = "case when e.old = '' then 0 else cast((length(f.content) - length(replace(f.content, e.old, ''))) / greatest(length(e.old), 1) as bigint) end"
    return f"(select e.file_id, e.path, e.seq, e.old, e.new, f.content, {n} as n, instr(f.content, e.old) as pos from edits e join files f on f.file_id = e.file_id)"


def outcome(d) -> str:
    """One place: applied, unless what is new stands there already and what was asked for with it; none or several: why not."""
    return "case when old = '' then 'invalid' when n = 1 and instr(new, old) > 0 and instr(content, new) > 0 then 'already_applied' when n = 1 then 'applied' when n > 1 then 'ambiguous' when new <> '' and instr(content, new) > 0 then 'already_applied' else 'no_match' end"


@both("mut04_item_application", "edits", "files")
def _(d):
    return f"select path, seq, n, {outcome(d)} as outcome, case when {outcome(d)} = 'applied' then {d.sha('replace(content, old, new)')} end as new_hash from {placed(d)} p"


@both("mut03_batch_outcome", "edits", "files")
def _(d):
    # a file's edits in the order of their places; those that overlap one before fail, as do those without one place; a strict
    # batch is a folder's files, and one that fails takes all back
    rows = f"select path, {d.extract('path', '^([^/]*)')} as batch, seq, pos, {outcome(d)} as outcome, max(case when n = 1 then pos + length(old) end) over (partition by path order by case when n = 1 then pos end, seq rows between unbounded preceding and 1 preceding) as reach from {placed(d)} p"
    files = f"select batch, path, count(*) as n, cast(count_if(outcome not in ('applied', 'already_applied')) as bigint) as missed, cast(count_if(outcome = 'applied' and coalesce(reach > pos, false)) as bigint) as conflicts from ({rows}) r group by batch, path"
    return f"select path, n, missed, conflicts, case when missed + conflicts = 0 then 'applied' when missed + conflicts < n then 'partly_applied' else 'failed' end as best_effort, case when sum(missed + conflicts) over (partition by batch) = 0 then 'applied' else 'rolled_back' end as strict from ({files}) f"


@both("mut05_transaction_state", "journal")
def _(d):
    # a transaction begins anew with each begin; what comes before one is none; the last of commit, rollback and undo counts
    runs = "select txn, seq, at_s, action, path, sum(case when action = 'begin' then 1 else 0 end) over (partition by txn order by seq rows between unbounded preceding and current row) as run from journal"
    return f"""select txn, run, n_edits, n_files, case when ended is null then 'open' when ended = 'commit' then 'committed' when ended = 'undo' then 'undone' else 'rolled_back' end as state from (
        select txn, cast(run as bigint) as run, cast(count_if(action = 'edit') as bigint) as n_edits, count(distinct case when action = 'edit' then path end) as n_files, max(case when rn = 1 and action in ('commit', 'rollback', 'undo') then action end) as ended from (
        select r.*, row_number() over (partition by txn, run order by case when action in ('commit', 'rollback', 'undo') then 0 else 1 end, seq desc) as rn from ({runs}) r where run > 0) x group by txn, run) y"""


@both("mut05_undo_versions", "journal")
def _(d):
    # what an undo brings back: the version of a file before its last committed edit
    return "select txn, path, seq as edit, lag(seq) over (partition by path order by seq) as version_before, lead(action) over (partition by txn order by seq) = 'undo' as undone from journal where action in ('edit', 'undo')"


@both("mut08_rename_plan", "lines", "refs", "symbols")
def _(d):
    # lines that hold the name as a word, by the text or by the index, and whether the file has the new name already
    word = "(^|[^A-Za-z0-9_])from([^A-Za-z0-9_]|$)"
    return f"""select l.path, l.line, l.text as old, {d.replace('l.text', word, '$1origin$2')} as new, d.file_id is not null as defines, r.file_id is not null as indexed, c.file_id is not null as conflict from lines l
        left join (select distinct file_id, start_line from symbols where name = 'from') d on d.file_id = l.file_id and d.start_line = l.line left join (select distinct file_id, line from refs where target_name = 'from') r on r.file_id = l.file_id and r.line = l.line
        left join (select distinct file_id from symbols where name = 'origin') c on c.file_id = l.file_id where {d.rlike('l.text', word)} or r.file_id is not null or d.file_id is not null"""


def names_in(d, table: str) -> str:
    return f"(select distinct file_id, {d.extract('text', '^([A-Za-z]+)')} as name from {d.each(f'(select file_id, content from {table}) t_', d.split('content', chr(92) + 'n'), 'k_ text', 'file_id')} n_)"


def names_gone(d) -> str:
    return f"select b.file_id, b.name from {names_in(d, 'before')} b left join {names_in(d, 'after')} a on a.file_id = b.file_id and a.name = b.name where a.name is null and b.name <> ''"


def diff_facts(d, gone: str, says: str, ends: str) -> str:
    """Of each file: what became of it, lines added and removed, names that went and came, and who elsewhere still says those that went."""
    came = f"select a.file_id, a.name from {names_in(d, 'after')} a left join {names_in(d, 'before')} b on a.file_id = b.file_id and a.name = b.name where b.name is null and a.name <> ''"
    count = lambda q: f"(select file_id, count(*) as n from ({q}) c group by file_id)"
    return f"""select f.path, f.state, coalesce(e.n_new - e.prefix - e.suffix, 0) as added, coalesce(e.n_old - e.prefix - e.suffix, 0) as removed, coalesce(g.n, 0) as names_gone, coalesce(c.n, 0) as names_new, coalesce(s.n, 0) as still_said from (
        select coalesce(a.file_id, b.file_id) as file_id, coalesce(a.path, b.path) as path, case when b.path is null then 'added' when a.path is null then 'removed' when {d.sha('a.content')} <> {d.sha('b.content')} then 'changed' else 'same' end as state from before b full outer join after a on a.file_id = b.file_id) f
        left join {ends} e on e.file_id = f.file_id left join {count(gone)} g on g.file_id = f.file_id left join {count(came)} c on c.file_id = f.file_id left join {says} s on s.file_id = f.file_id"""


_SAYS = f"(select g.file_id, count(*) as n from ({names_gone(DUCK)}) g join (select distinct file_id, target_name from refs) r on r.target_name = g.name and r.file_id <> g.file_id group by g.file_id)"


@query("mut10_diff_facts", with_ctes(diff_facts(DUCK, names_gone(DUCK), _SAYS, common_ends(DUCK)), DUCK, ("before", "after", "refs")))
def _(spark, source):
    """Who elsewhere says a name is how many files say it, but for the own one, so no file meets every file that says its
    names. Two versions of a file meet as one row; ids that stand twice go by their lines, as in the SQL."""
    before, after = relation(spark, source, "before"), relation(spark, source, "after")
    gone = stored(run(spark, source, names_gone(SPARK), ("before", "after")))
    refs = relation(spark, source, "refs").where("file_id is not null").select("file_id", F.col("target_name").alias("name"))
    words = stored(refs.join(gone.select("name").distinct(), "name", "left_semi").select("file_id", "name").distinct())
    ids = lambda t: t.groupBy("file_id").agg(F.count("*").alias("n"))
    twice = stored(ids(before).union(ids(after)).where("n > 1").select("file_id").distinct())
    sides = [t.join(twice, "file_id", "left_semi").select("file_id", "content") for t in (before, after)]
    ends = stored(run(spark, Relations(dict(zip(("before", "after"), sides, strict=True))), f"select * from {common_ends(SPARK)} e", ("before", "after")))
    once = [t.join(twice, "file_id", "left_anti").select("file_id", F.split("content", "\n", -1).alias(c)) for t, c in ((before, "old"), (after, "new"))]
    n = F.least(F.size("old"), F.size("new"))
    # the first line that differs, from 1; 0 if none of the first n does
    differs = lambda old, new: F.array_position(F.zip_with(F.slice(old, 1, n), F.slice(new, 1, n), lambda x, y: x != y), True)
    same = lambda at: F.when(at == 0, n).otherwise(at - 1).cast("long")
    pairs = once[0].join(once[1], "file_id").where("old is not null and new is not null").select("file_id", F.size("old").cast("long").alias("n_old"), F.size("new").cast("long").alias("n_new"), same(differs("old", "new")).alias("prefix"), same(differs(F.reverse("old"), F.reverse("new"))).alias("ending"))
    ends = ends.unionByName(stored(pairs.withColumn("suffix", F.least("ending", F.least("n_old", "n_new") - F.col("prefix"))).drop("ending")))
    tables = Relations({"before": before, "after": after, "gone_names": gone, "said_words": words, "both_ends": ends})
    says = """(select g.file_id, sum(u.n - if(o.file_id is null, 0, 1)) as n from gone_names g join (select name, count(*) as n from said_words group by name) u on u.name = g.name
        left join said_words o on o.file_id = g.file_id and o.name = g.name group by g.file_id)"""
    return run(spark, tables, diff_facts(SPARK, "select * from gone_names", says, "both_ends"), ("before", "after"))


@both("mut11_worktree_outcome", "journal")
def _(d):
    # a transaction's steps: none may be missing before it, and what fails after the commit leaves the commit alone
    return """select txn, case when begins = 0 then 'not_begun' when commits = 0 and failures > 0 then 'transaction_rolled_back' when commits > 0 and failed_after then 'merge_failed_commit_preserved' when commits > 0 then 'merged' else 'open' end as outcome, commits > 0 and failed_after as keeps_branch from (
        select txn, cast(count_if(action = 'begin') as bigint) as begins, cast(count_if(action = 'commit') as bigint) as commits, cast(count_if(action = 'rollback') as bigint) as failures, coalesce(max(case when action = 'rollback' then seq end) > max(case when action = 'commit' then seq end), false) as failed_after from journal group by txn) x"""


@both("src16_transaction_scan", "journal")
def _(d):
    return "select txn, count(*) as entries, count(distinct path) as n_files, min(at_s) as started, max(at_s) as ended, max(case when rn = 1 then action end) as last_action from (select j.*, row_number() over (partition by txn order by seq desc) as rn from journal j) x group by txn"


@both("snk06_journal_table", "journal")
def _(d):
    # the audit log: each entry with the one before it on the same file, and how long that was ago
    return "select seq, txn, path, action, lag(action) over (partition by path order by seq) as previous, at_s - lag(at_s) over (partition by path order by seq) as since from journal"


@both("stm09_reindex_job", "files", "symbols")
def _(d):
    # a folder's job: how far the index has come, how long it will take, and whether it is to be confirmed first
    return "select f.dir, count(*) as n, count(*) > 2000 as needs_confirmation, cast(ceil(1 + count(*) / 100.0) as bigint) as eta_s, cast(floor(100.0 * count(s.file_id) / count(*)) as bigint) as progress from files f left join (select distinct file_id from symbols) s on s.file_id = f.file_id group by f.dir"


@both("stm09_confirmations", "journal")
def _(d):
    # a token is good for ten minutes and for one use: the next commit of the same session
    return "select txn, seq, action, case when action <> 'begin' then null when next_action = 'commit' and next_at - at_s <= 600 then 'confirmed' when next_action = 'commit' then 'expired' else 'unused' end as token from (select txn, seq, at_s, action, lead(action) over (partition by txn order by seq) as next_action, lead(at_s) over (partition by txn order by seq) as next_at from journal) x"


@both("stm12_journal_prune", "journal")
def _(d):
    # entries older than a day go, but for those of transactions that are still open
    return """select j.seq, j.at_s < n.now - 86400 and s.ended is not null as pruned from journal j cross join (select max(at_s) as now from journal) n left join (select txn, max(case when action in ('commit', 'rollback', 'undo') then seq end) as ended, max(case when action = 'begin' then seq end) as begun from journal group by txn) s
        on s.txn = j.txn and s.ended > coalesce(s.begun, -1)"""


@both("stm13_cache_gc", "journal")
def _(d):
    # a workspace's cache is collected when it was last used a week before the newest, unless a transaction in it is open
    return """select txn as workspace, last_used, last_used < now - 7 * 86400 and not is_open as collect from (select txn, last_used, is_open, max(last_used) over () as now from (
        select txn, max(at_s) as last_used, coalesce(max(case when action = 'begin' then seq end) > coalesce(max(case when action in ('commit', 'rollback', 'undo') then seq end), -1), false) as is_open from journal group by txn) a) x"""

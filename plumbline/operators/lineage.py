"""Lineage over a history: ancestors in the commit graph, and files followed over renames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.history import volatility_of
from plumbline.session import written


def ends_of(links: DataFrame) -> DataFrame:
    """(id, end, steps) of links (id, next), next null at an end: where each id's links lead, by doubling.

    Every round squares the reach, so a line of n ids takes log2(n) rounds.
    Links must not close a ring.
    """
    at = written(links.select("id", F.coalesce("next", "id").alias("end"), F.col("next").isNotNull().cast("long").alias("steps"), F.col("next").isNotNull().alias("open")))
    while not at.where("open").isEmpty():
        further = at.select(F.col("id").alias("end"), F.col("end").alias("far"), F.col("steps").alias("more"), F.col("open").alias("still"))
        at = written(at.join(further, "end").select("id", F.col("far").alias("end"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("still") & (F.col("more") > 0)).alias("open")))
    return at.drop("open")


def chains(commits: DataFrame) -> DataFrame:
    """(sha, chain, pos): commits laid out in chains of first parents, pos 0 at the oldest of each.

    A commit goes on with its first parent unless an earlier child already does.
    """
    first = commits.select("sha", "seq", F.get("parents", F.lit(0)).alias("p"))
    known = commits.select(F.col("sha").alias("p"))  # a cut history names parents that it doesn't hold
    taken = first.where("p is not null").join(known, "p", "left_semi").groupBy("p").agg(F.min_by("sha", "seq").alias("sha"))
    links = commits.select("sha").join(taken, "sha", "left").select(F.col("sha").alias("id"), F.col("p").alias("next"))
    return ends_of(links).select(F.col("id").alias("sha"), F.col("end").alias("chain"), F.col("steps").alias("pos"))


def ancestors(commits: DataFrame, tips: DataFrame) -> DataFrame:
    """(tip, sha): every commit that each tip reaches through parents, itself included.

    commits is (seq, sha, parents) with parents before children. What a tip
    reaches of a chain is all below one position, so the frontier is a position
    for each chain, moved up until nothing moves: the rounds follow the changes
    of chain on a path, not its length. Tips that aren't commits reach nothing.
    """
    placed = written(chains(commits))
    pairs = commits.select("sha", F.explode("parents").alias("parent"))
    at = placed.select(F.col("sha").alias("parent"), F.col("chain").alias("to"), F.col("pos").alias("to_pos"))
    edges = written(pairs.join(placed, "sha").join(at, "parent").where("chain != to or to_pos != pos - 1").select("chain", "pos", "to", "to_pos"))
    reached = written(tips.select(F.col("tip").alias("sha")).distinct().join(placed, "sha").select(F.col("sha").alias("tip"), "chain", F.col("pos").alias("top")))
    fresh = reached.withColumn("low", F.lit(-1).cast("long"))
    while not fresh.isEmpty():
        hit = fresh.join(edges, "chain").where("pos > low and pos <= top").groupBy("tip", F.col("to").alias("chain")).agg(F.max("to_pos").alias("new"))
        both = written(reached.join(hit, ["tip", "chain"], "full_outer"))
        fresh = written(both.where("new is not null and (top is null or new > top)").select("tip", "chain", F.col("new").alias("top"), F.coalesce("top", F.lit(-1)).cast("long").alias("low")))
        reached = both.select("tip", "chain", F.greatest("top", "new").alias("top"))
    return placed.join(reached, "chain").where("pos <= top").select("tip", "sha")


def bounded_volatility(commits: DataFrame, touches: DataFrame, tips: DataFrame) -> DataFrame:
    """(tip, item, volatility): changes of items in the ancestry of each tip alone, over those of the most changed one.

    touches is (sha, item), an item counting once a commit; merges don't count.
    """
    plain = commits.where(F.size("parents") < 2).select("sha")
    seen = ancestors(commits, tips).join(plain, "sha", "left_semi")
    return volatility_of(touches.select("sha", "item").distinct().join(seen, "sha"), ["tip"])


def lives(changes: DataFrame) -> DataFrame:
    """(path, born, until, first): the lives of each path, and the identity that a life belongs to.

    changes is (seq, status, path, old_path). A life begins with an addition,
    a copy or a rename to the path, or with its first change where the history
    holds no beginning, and ends where the next one begins. A rename goes on with
    the life that its old path had just before; of several renames that leave one
    life the earliest goes on, the others begin anew. first is `seq path` of the
    identity's first life.
    """
    births = changes.where(F.col("status").isin("A", "C", "R")).groupBy("path", "seq").agg(F.min(F.when(F.col("status") == "R", F.col("old_path"))).alias("old"))
    known = births.groupBy("path").agg(F.min("seq").alias("first_birth"))
    seen = changes.where(~F.col("status").isin("A", "C", "R")).groupBy("path").agg(F.min("seq").alias("seq"))
    unborn = seen.join(known, "path", "left").where("first_birth is null or seq < first_birth").select("path", "seq", F.lit(None).cast("string").alias("old"))
    after = F.lead("seq").over(Window.partitionBy("path").orderBy("seq"))
    born = written(births.unionByName(unborn).withColumn("until", after).withColumn("id", F.concat_ws(" ", F.col("seq").cast("string"), "path")))
    before = born.select(F.col("path").alias("old"), F.col("seq").alias("old_seq"), F.col("until").alias("old_until"), F.col("id").alias("next"))
    from_old = born.where("old is not null").select("id", "seq", "path", "old").join(before, "old").where("old_seq < seq and (old_until is null or old_until >= seq)")
    heirs = from_old.groupBy("next").agg(F.min_by("id", F.struct("seq", "path")).alias("id"))
    links = born.select("id").join(heirs, "id", "left").select("id", "next")
    return born.join(ends_of(links), "id").select("path", F.col("seq").alias("born"), "until", F.col("end").alias("first"))


def followed(changes: DataFrame) -> DataFrame:
    """(path, seq): the commits of each file that is there at the end, under all the names that it had.

    A file is there when the last life of its path isn't ended by a removal or by a rename that leaves it.
    """
    life = written(lives(changes))
    on = changes.select("seq", "status", "path")
    # A removal belongs to the life before it, also where the path begins anew in the same commit.
    inside = (F.col("seq") >= F.col("born")) & (F.col("until").isNull() | (F.col("seq") < F.col("until")))
    touched = on.where("status != 'D'").join(life, "path").where(inside).select("first", "seq")
    ended = (F.col("seq") > F.col("born")) & (F.col("until").isNull() | (F.col("seq") <= F.col("until")))
    gone = on.where("status = 'D'").join(life, "path").where(ended).select("first", "path", "born", "seq")
    left = changes.where("status = 'R'").select(F.col("old_path").alias("path"), "seq").join(life, "path").where(ended).select("path", "born")
    dead = gone.select("path", "born").unionByName(left).distinct()
    alive = life.where("until is null").join(dead, ["path", "born"], "left_anti").select("path", "first")
    return alive.join(touched.unionByName(gone.select("first", "seq")).distinct(), "first").select("path", "seq")

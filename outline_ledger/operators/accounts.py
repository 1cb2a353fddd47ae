"""Account-code set logic: O-42 parent test (prefix explode + semi-join),
O-43 suppression set, O-32 anti-join, O-44 account 94.Н in control tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ACCOUNT_94, ACCOUNT_94_N, ACCOUNTS_WITHOUT_SUBACCOUNT
from ..functions.scalars import dotted_prefixes


def parent_accounts(accounts: DataFrame, scope: list[str], acct: str) -> DataFrame:
    """O-42 / O-33: accounts of the set that some other account of the same
    scope extends (``other`` starts with ``acct + '.'``).  Every code is
    exploded into its proper dotted prefixes and semi-joined back to the set:
    linear in the number of codes, no pairwise comparison."""
    codes = accounts.select(*scope, F.col(acct).alias("__code")).where(F.col("__code").isNotNull()).distinct()
    prefixes = codes.select(*scope, F.explode(dotted_prefixes(F.col("__code"))).alias("__p")) \
        .where(F.col("__p").isNotNull()).distinct()
    return codes.join(prefixes.withColumnRenamed("__p", "__code"), on=scope + ["__code"], how="left_semi") \
        .withColumnRenamed("__code", acct)


def flag_parents(df: DataFrame, scope: list[str], acct: str, out: str = "is_parent") -> DataFrame:
    """Add a boolean column: the row's account has sub-accounts in its scope."""
    par = parent_accounts(df, scope, acct).withColumn(out, F.lit(True))
    return df.join(par, on=scope + [acct], how="left").withColumn(out, F.coalesce(F.col(out), F.lit(False)))


def suppression_set(pairs: DataFrame, scope: list[str], raw: str, acct: str, *,
                    add_unpadded: bool = True, strict: bool = False) -> DataFrame:
    """O-43: accounts whose rows duplicate detail and must be removed.

    From distinct (raw cell, account) pairs: delete = accounts seen with more
    than one raw cell ∪ parent accounts; if ``94.Н`` is present, every other
    account containing ``94``; every account containing ``55`` / ``57`` other
    than those two; minus ``55`` and ``57`` themselves; plus the unpadded form
    of deleted digit codes (``07`` -> ``7``).  ``strict=True`` uses prefix
    matching instead of substring matching for 94/55/57.
    """
    p = pairs.where(F.col(acct).isNotNull()).select(*scope, raw, acct).distinct()
    counts = p.groupBy(*scope, acct).agg(F.count(F.lit(1)).alias("__n"))
    keys = scope + [acct]
    many = counts.where(F.col("__n") > 1).select(*keys)
    parents = parent_accounts(counts, scope, acct).select(*keys)

    def touches(code: str) -> Column:
        return F.col(acct).startswith(code) if strict else F.col(acct).contains(code)

    has94n = counts.where(F.col(acct) == ACCOUNT_94_N).select(*scope).distinct()
    del94 = counts.join(has94n, on=scope, how="left_semi") \
        .where(touches(ACCOUNT_94) & (F.col(acct) != ACCOUNT_94_N)).select(*keys)
    cond = F.lit(False)
    for code in ACCOUNTS_WITHOUT_SUBACCOUNT:
        cond = cond | (touches(code) & (F.col(acct) != code))
    del55 = counts.where(cond).select(*keys)
    dele = many.unionByName(parents).unionByName(del94).unionByName(del55).distinct() \
        .where(~F.col(acct).isin(ACCOUNTS_WITHOUT_SUBACCOUNT))
    if add_unpadded:
        unpadded = dele.where(F.col(acct).rlike("^0[0-9]+$")) \
            .select(*scope, F.col(acct).cast("long").cast("string").alias(acct))
        dele = dele.unionByName(unpadded).distinct()
    return dele


def remove_accounts(df: DataFrame, suppressed: DataFrame, scope: list[str], acct: str,
                    set_acct: str | None = None) -> DataFrame:
    """O-32: anti-join rows whose account is in the suppression set; rows with
    a null account survive (pandas ``~isin``)."""
    ren = {k: f"__s_{i}" for i, k in enumerate(scope)}
    s = suppressed.select(*[F.col(k).alias(v) for k, v in ren.items()],
                          F.col(set_acct or acct).alias("__sup"))
    cond = [F.col(k) == F.col(v) for k, v in ren.items()] + [F.col(acct) == F.col("__sup")]
    return df.join(s, on=cond, how="left_anti")


def control_94(df: DataFrame, acct: str, scope: list[str], *, dialect: str = "upp") -> DataFrame:
    """O-44: account 94.Н in the control table.  First dialect: when 94.Н is
    present in the scope, keep it and drop 94 and 94.xx.  Second dialect: drop
    94, then report 94.Н as 94."""
    assert scope, "control_94 needs a scope (the file column)"
    if dialect == "upp":
        has = df.where(F.col(acct) == ACCOUNT_94_N).select(*scope).distinct().withColumn("__h", F.lit(True))
        d = df.join(has, on=scope, how="left")
        drop = F.coalesce(F.col("__h"), F.lit(False)) & (F.col(acct) != ACCOUNT_94_N) & \
            ((F.col(acct) == ACCOUNT_94) | F.col(acct).rlike(r"^94\..{2}$"))
        return d.where(~drop).drop("__h")
    d = df.where(F.coalesce(F.col(acct) != ACCOUNT_94, F.lit(True)))
    return d.withColumn(acct, F.when(F.col(acct) == ACCOUNT_94_N, F.lit(ACCOUNT_94)).otherwise(F.col(acct)))

"""Users, invites, resets, runs and file pairs: state that follows from append-only events.

Parquet tables are not updated in place. Changes are events; the current state is the
last one of each key, by time and then by order of arrival. Where time counts, ``as_of``
is an argument, so that results repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How long links hold, and the messages of file pairs and runs.
INVITE_HOURS, RESET_HOURS = 72, 2
ALLOWED = {"used": ("pending", "link_generated"), "cancelled": ("pending", "requested", "link_generated"), "link_generated": ("requested", "link_generated")}
MESSAGES = {"queued": "Prepared and waiting to run.", "running": "QA is running.", "done": "QA completed.", "error": "QA failed.", "interrupted": "Server stopped before this file completed."}


def latest_status(events: DataFrame, key: str, at: str = "ts", order: str = "event_id", status: str = "status") -> DataFrame:
    """The last status of each key."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(at, order)).alias(status))


def latest_rows(rows: DataFrame, keys: list[str], at: str, order: str) -> DataFrame:
    """The last row of each key, whole: an upsert of ``rows`` in order of time."""
    last = F.max_by(F.struct(*rows.columns), F.struct(at, order)).alias("r")
    return rows.groupBy(*keys).agg(last).select("r.*")


def transition(now: Column, to: str) -> Column:
    """The state after a wish to go to ``to``: invites and resets leave open states only."""
    return F.when(now.isin(*ALLOWED[to]), to).otherwise(now)


def expires(at: Column, hours: int) -> Column:
    return at + F.make_dt_interval(hours=F.lit(hours))


def is_valid(status: Column, expires_at: Column, as_of: Column) -> Column:
    return status.isin("pending", "link_generated") & (expires_at >= as_of)


def invalid_reason(kind: str, status: Column, expires_at: Column, as_of: Column) -> Column:
    """Why an ``invite`` or ``reset`` link does not hold; empty if it does. Reset links without an end have expired."""
    if kind == "invite":
        return F.when(status != "pending", "Invite has already been used or cancelled.").when(expires_at < as_of, "Invite link has expired.").otherwise("")
    expired = F.coalesce(expires_at < as_of, F.lit(True))
    return F.when(status != "link_generated", "Reset link has already been used or cancelled.").when(expired, "Reset link has expired. Ask your administrator for a new one.").otherwise("")


def with_inviter(invites: DataFrame, users: DataFrame) -> DataFrame:
    """Invites with the name of who made them, where that is known."""
    return invites.join(users.select(F.col("id").alias("created_by"), F.col("username").alias("invited_by")), "created_by", "left")


def with_account(resets: DataFrame, users: DataFrame) -> DataFrame:
    """Resets with the present name and status of their accounts, where there are any."""
    return resets.join(users.select(F.col("id").alias("user_id"), F.col("username").alias("current_username"), F.col("status").alias("user_status")), "user_id", "left")


def with_actor(audit: DataFrame, users: DataFrame) -> DataFrame:
    """Audit rows with the actor's name as it is; empty for none."""
    return audit.join(users.select(F.col("id").alias("user_id"), F.col("username").alias("actor")), "user_id", "left").withColumn("actor", F.coalesce("actor", F.lit("")))


def find_login(users: DataFrame, login: str) -> DataFrame:
    """Active users with this name or address, in any case."""
    wanted = login.strip().lower()
    return users.where((F.lower("username") == wanted) | (F.lower("email") == wanted)).where("status = 'active'")


def sync_admin(users: DataFrame, email: str, username: str) -> DataFrame:
    """``users`` with one admin, who has this address and name.

    The account is the first by id with that address or name, else the first admin. Others
    with the same address or name are renamed, other admins become users. With neither, no
    row changes but for those admins: there are none.
    """
    email, username = email.strip().lower(), username.strip().lower()
    same = F.coalesce((F.lower("email") == email) | (F.lower("username") == username), F.lit(False))
    admin = F.coalesce(F.col("role") == "admin", F.lit(False))
    chosen = users.agg(F.coalesce(F.min(F.when(same, F.col("id"))), F.min(F.when(admin, F.col("id")))).alias("_admin"))
    both = users.join(F.broadcast(chosen), F.lit(True))  # one row
    is_it, clash = F.col("id").eqNullSafe(F.col("_admin")), same & ~F.col("id").eqNullSafe(F.col("_admin"))
    renamed = lambda c, other: F.concat(F.lit("disabled_"), F.col("id"), F.lit("_"), F.coalesce(F.nullif(c, F.lit("")), other))
    stand_in = F.concat(F.lit("user"), F.col("id"))
    out = {
        "email": F.when(is_it, email).when(clash, renamed("email", F.concat(stand_in, F.lit("@disabled.local")))).otherwise(F.col("email")),
        "username": F.when(is_it, username).when(clash, renamed("username", stand_in)).otherwise(F.col("username")),
        "role": F.when(is_it, "admin").when(admin, "user").otherwise(F.col("role")),
        "status": F.when(is_it, "active").otherwise(F.col("status")),
    }
    return both.select(*(out.get(c, F.col(c)).alias(c) for c in users.columns))


def create_users(users: DataFrame, wanted: DataFrame) -> DataFrame:
    """Active accounts for ``wanted`` (email, username) whose address and name are free; names in lower case. Of equal wishes the first by address stays."""
    clean = wanted.select(F.lower(F.trim("email")).alias("email"), F.lower(F.trim("username")).alias("username"))
    for key in ("email", "username"):
        clean = clean.join(users.select(F.lower(key).alias(key)).distinct(), key, "left_anti")
        other = "username" if key == "email" else "email"
        clean = clean.groupBy(key).agg(F.min(other).alias(other))
    return clean.select("email", "username", F.lit("user").alias("role"), F.lit("active").alias("status"))


def create_invites(wanted: DataFrame, hours: int = INVITE_HOURS) -> DataFrame:
    """Pending invites for ``wanted`` (email, token, created_by, at); only the token's hash is kept. All invite plain users."""
    address = F.coalesce(F.lower(F.trim("email")), F.lit(""))
    return wanted.select(address.alias("email"), F.lit("user").alias("role"), F.sha2("token", 256).alias("token_hash"), F.lit("pending").alias("status"), "created_by", F.col("at").alias("created_at"), expires(F.col("at"), hours).alias("expires_at"))


def _first_use(uses: DataFrame, links: DataFrame, kind: str) -> DataFrame:
    """Valid ``links`` (id, token_hash, status, expires_at) with the first of their ``uses`` (token, at), as the column ``use``.

    A link that is past its end at the first use is past it at any later one, and a used one is spent.
    """
    first = uses.withColumn("token_hash", F.sha2("token", 256)).groupBy("token_hash").agg(F.min_by(F.struct(*uses.columns), "at").alias("use"))
    return links.join(first, "token_hash").where(invalid_reason(kind, F.col("status"), F.col("expires_at"), F.col("use.at")) == "")


def _marked(links: DataFrame, used: DataFrame) -> DataFrame:
    """``links`` in which those of ``used`` (id, used_at) have been used."""
    both = links.drop("used_at").join(used, "id", "left")
    return both.withColumn("status", F.when(F.col("used_at").isNotNull(), "used").otherwise(F.col("status")))


def consume_invites(invites: DataFrame, uses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New users, and ``invites`` as they are after ``uses`` (token, username, password_hash, at)."""
    used = _first_use(uses, invites, "invite")
    users = used.select("email", F.lower(F.trim("use.username")).alias("username"), F.col("use.password_hash").alias("password_hash"), "role", F.lit("active").alias("status"), F.col("use.at").alias("created_at"), "created_by")
    return users, _marked(invites, used.select("id", F.col("use.at").alias("used_at")))


def request_resets(users: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested resets for ``requests`` (login, at, ip) of active accounts by name or address, in any case; others give no row.

    Where one account's name is another's address, the account with the lesser id is meant.
    """
    active = users.where("status = 'active'")
    known = active.select("id", "username", "email", F.explode(F.array_distinct(F.array(F.lower("username"), F.lower("email")))).alias("_login")).where("_login is not null")
    one = known.groupBy("_login").agg(F.min_by(F.struct("id", "username", "email"), "id").alias("u"))
    wanted = requests.withColumn("_login", F.lower(F.trim("login")))
    return wanted.join(one, "_login").select(F.col("u.id").alias("user_id"), F.col("u.username").alias("username_snapshot"), F.col("u.email").alias("email_snapshot"), F.lit("requested").alias("status"), F.col("at").alias("requested_at"), F.coalesce("ip", F.lit("")).alias("request_ip"))


def generate_links(resets: DataFrame, wanted: DataFrame, hours: int = RESET_HOURS) -> DataFrame:
    """``resets`` after links for ``wanted`` (id, token, admin_id, at) were made, where the reset is still open; the last link counts."""
    last = wanted.groupBy("id").agg(F.max_by(F.struct("token", "admin_id", "at"), "at").alias("_link"))
    both = resets.join(last, "id", "left")
    made = F.col("_link").isNotNull() & F.col("status").isin(*ALLOWED["link_generated"])
    new = {"token_hash": F.sha2("_link.token", 256), "link_generated_at": F.col("_link.at"), "expires_at": expires(F.col("_link.at"), hours), "generated_by": F.col("_link.admin_id"), "status": F.lit("link_generated")}
    old = {c: F.col(c) if c in resets.columns else F.lit(None) for c in new}
    return both.withColumns({c: F.when(made, v).otherwise(old[c]) for c, v in new.items()}).drop("_link")


def consume_resets(resets: DataFrame, uses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes for ``update_users`` (id, password_hash), the last of each account, and ``resets`` as they are after ``uses`` (token, password_hash, at)."""
    used = _first_use(uses, resets, "reset")
    changes = used.groupBy(F.col("user_id").alias("id")).agg(F.max_by("use.password_hash", F.struct("use.at", used["id"])).alias("password_hash"))
    return changes, _marked(resets, used.select("id", F.col("use.at").alias("used_at")))


def update_users(users: DataFrame, changes: DataFrame) -> DataFrame:
    """``users`` after ``changes`` (id and any of status, role, password_hash, last_login_at; one row for an account); null changes nothing.

    Any status but active disables, and any role but admin is user.
    """
    fields = [c for c in ("status", "role", "password_hash", "last_login_at") if c in changes.columns]
    both = users.join(changes.select("id", F.struct(*fields).alias("_new")), "id", "left")
    known = {"status": ("active", "disabled"), "role": ("admin", "user")}

    def after(c: str) -> Column:
        new, old = F.col(f"_new.{c}"), F.col(c) if c in users.columns else F.lit(None)
        if c in known:
            new = F.when(new == known[c][0], new).when(new.isNotNull(), known[c][1])
        return F.coalesce(new, old)

    return both.withColumns({c: after(c) for c in fields}).drop("_new")


def pair_state(events: DataFrame) -> DataFrame:
    """File pairs from ``events`` (pair_id, status, ts, event_id): status, message, first start, last end."""
    last = latest_status(events, "pair_id")
    times = events.groupBy("pair_id").agg(F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started_at"), F.max(F.when(F.col("status").isin("done", "error", "interrupted"), F.col("ts"))).alias("finished_at"))
    messages = F.create_map(*(F.lit(x) for pair in MESSAGES.items() for x in pair))
    return last.join(times, "pair_id").withColumn("status_message", F.try_element_at(messages, F.col("status")))


def keep_first(old: Column, new: Column) -> Column:
    """An end that is set once stays."""
    return F.coalesce(old, new)


def first_admin(users: DataFrame) -> DataFrame:
    return users.where("role = 'admin'").orderBy("id").limit(1).select("id", "username", "role", "status")


"""Booking commands: checks, amounts, ledger replay, patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from acreage import constants as K
from acreage.functions import scalars as S
from acreage.functions import text as T
from acreage.session import first_per_key


def validate_bookings(df: DataFrame) -> DataFrame:
    """Adds ``error``: the first failing rule, null for good commands."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return df.withColumn(
        "error",  # fixed values: messages of the checks
        F.when(blank("customer_name"), "Customer Name is required.")
        .when(blank("customer_phone"), "Customer Phone Number is required.")
        .when(F.col("booking_amount").isNull() | (F.col("booking_amount") <= 0), "Booking amount must be greater than 0."),
    )


def validate_projects(df: DataFrame) -> DataFrame:
    """Adds ``failed``: the names of all failing rules."""

    def rule(ok: Column, name: str) -> Column:
        return F.when(~F.coalesce(ok, F.lit(False)), name)

    long_enough = lambda c, n: F.length(F.trim(c)) >= n
    rules = [
        rule(long_enough("name", 2), "name"),
        rule(long_enough("developer_name", 2), "developer_name"),
        rule(F.length("pincode") == 6, "pincode"),
        rule(F.col("gross_land_area") > 0, "gross_land_area"),
        rule(F.exists("survey_numbers", lambda s: F.trim(s) != ""), "survey_numbers"),
    ]
    return df.withColumn("failed", F.filter(F.array(*rules), lambda r: r.isNotNull()))


def with_amounts(bookings: DataFrame) -> DataFrame:
    """Booking rows with total, paid, remaining and payment state worked out."""
    amounts = S.booking_amounts("base_price", "total_amount", "booking_amount", "paid_amount")
    return bookings.withColumn("amounts", amounts).select(
        *[c for c in bookings.columns if c not in ("total_amount", "paid_amount")],
        F.col("amounts.total").cast("double").alias("total_amount"), F.col("amounts.paid").cast("double").alias("paid_amount"),
        F.col("amounts.remaining").cast("double").alias("remaining_amount"), F.col("amounts.payment_status").alias("payment_status"),
    )


def bookings_with_plot(bookings: DataFrame, plots: DataFrame) -> DataFrame:
    return bookings.join(plots.select("plot_id", "plot_number"), "plot_id", "left")


def active_bookings(bookings: DataFrame) -> DataFrame:
    """Latest BOOKED row of every plot."""
    live = bookings.filter(F.col("booking_status") == "BOOKED")
    return first_per_key(live, ["plot_id"], [F.desc("created_at"), F.desc("booking_id")])


def plots_with_active_booking(plots: DataFrame, bookings: DataFrame) -> DataFrame:
    live = active_bookings(bookings).select("plot_id", F.col("booking_id").alias("active_booking_id"), "customer_name")
    return plots.join(live, "plot_id", "left")


def state_after(command: Column, patch_status: Column) -> Column:
    """State a command leaves behind; a rejected booking leaves the BOOKED state it met."""
    return F.when(command == "book", "BOOKED").when(command == "cancel", "AVAILABLE").when(
        command == "patch", F.upper(F.trim(patch_status))
    )


def replay_bookings(
    commands: DataFrame, initial: DataFrame | None = None, slice_by: str = "hour", strict: bool = False
) -> DataFrame:
    """Decide every command from the state its predecessor left.

    The state after a command does not depend on the state before it, so the previous row
    is all that is needed. A plot's history is cut into time slices: inside a slice the
    previous row comes from a window, the first row of a slice takes the last state of the
    nearest earlier slice from a table with one row per slice. No task ever holds the whole
    history of a busy plot.

    ``strict`` also rejects bookings of sold, reserved or blocked plots.
    """
    order = [F.col("ts"), F.col("seq")]
    moves = commands.withColumn("state_after", state_after(F.col("command"), F.col("patch_status"))).filter(
        F.col("state_after").isNotNull()
    ).withColumn("__slice", F.date_trunc(slice_by, "ts"))
    inside = Window.partitionBy("plot_id", "__slice").orderBy(*order)
    moves = moves.withColumn("__prev", F.lag("state_after").over(inside)).withColumn(
        "__first", F.row_number().over(inside) == 1
    )
    per_slice = moves.groupBy("plot_id", "__slice").agg(
        F.max(F.struct("ts", "seq", "state_after")).alias("__last")
    )
    across = Window.partitionBy("plot_id").orderBy("__slice")
    carried = per_slice.select(
        "plot_id", "__slice", F.lag("__last.state_after").over(across).alias("__carried")
    )
    known = moves.join(carried, ["plot_id", "__slice"])
    start = F.lit("AVAILABLE")
    if initial is not None:
        known = known.join(initial.select("plot_id", F.upper("status").alias("__start")), "plot_id", "left")
        start = F.coalesce("__start", start)
    before = F.coalesce(F.when(F.col("__first"), F.col("__carried")).otherwise(F.col("__prev")), start)
    blocked = before.isin("BOOKED", "SOLD", "RESERVED", "BLOCKED") if strict else before == "BOOKED"
    rejected = (F.col("command") == "book") & blocked
    after = F.when(rejected, before).otherwise(F.col("state_after")) if strict else F.col("state_after")
    return known.select(
        *commands.columns, before.alias("state_before"), (~rejected).alias("accepted"), after.alias("state_after")
    )


def final_states(decided: DataFrame) -> DataFrame:
    """Current state of each plot and its command counts."""
    return decided.groupBy("plot_id").agg(
        F.max_by("state_after", F.struct("ts", "seq")).alias("status"),
        F.count(F.lit(1)).alias("commands"), F.count_if(~F.col("accepted")).alias("rejected"),
    )


def apply_booking_patch(bookings: DataFrame, patches: DataFrame) -> DataFrame:
    """Field updates: paid wins over booking amount, blank optional text clears, remaining follows."""
    p = patches.select("booking_id", *[F.col(c).alias(f"__{c}") for c in patches.columns if c != "booking_id"])
    has = lambda c: f"__{c}" in p.columns
    new = lambda c: F.col(f"__{c}")
    zero = F.lit(0).cast("decimal(18,2)")
    money = lambda c: F.greatest(new(c).cast("decimal(18,2)"), zero)
    cols = {c: F.col(c) for c in bookings.columns}
    for c in ("customer_name", "customer_phone", "payment_method"):
        if has(c):
            cols[c] = F.coalesce(T.blank_to_null(new(c)), F.col(c))
    for c in ("payment_status", "booking_status"):
        if has(c):
            cols[c] = F.coalesce(F.upper(T.blank_to_null(new(c))), F.col(c))
    for c in ("customer_email", "customer_address", "transaction_id", "notes"):
        if has(c):
            cols[c] = F.when(new(c).isNotNull(), T.blank_to_null(new(c))).otherwise(F.col(c))
    if has("booking_date"):
        cols["booking_date"] = S.parse_ts(new("booking_date"), "booking_date")
    paid = money("paid_amount") if has("paid_amount") else F.lit(None).cast("decimal(18,2)")
    deposit = money("booking_amount") if has("booking_amount") else F.lit(None).cast("decimal(18,2)")
    if has("paid_amount"):
        deposit = F.when(new("paid_amount").isNull(), deposit)
    cols["booking_amount"] = F.coalesce(deposit, F.col("booking_amount").cast("decimal(18,2)"))
    now_paid = F.coalesce(paid, deposit, F.col("paid_amount").cast("decimal(18,2)"))
    cols["paid_amount"] = now_paid
    cols["remaining_amount"] = F.greatest((F.col("total_amount").cast("decimal(18,2)") - now_paid).cast("decimal(18,2)"), zero)
    return bookings.join(p, "booking_id", "left").select(*[v.alias(k) for k, v in cols.items()])


def apply_status_patches(plots: DataFrame, bookings: DataFrame, patches: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """State patches on plots, with their effect on bookings.

    A patch sets what it names: status, notes, base price, customer id (blank clears), reservation date (blank clears, an unreadable
    one is ``as_of``). The plot's state after the patch decides about bookings, also when the patch names no state: SOLD or BOOKED
    keeps the active booking (contact updated, a blank e-mail clears it) or opens a fully paid direct one; AVAILABLE cancels the
    active bookings and clears the customer. A patch with an invalid state is refused as a whole. One patch per plot. Returns the
    new plots and the new bookings.
    """
    given = lambda c: F.col(c) if c in patches.columns else F.lit(None).cast("string")
    named = F.upper(F.trim(given("status")))
    good = patches.filter(named.isNull() | named.isin(*K.PLOT_STATES)).select(
        "plot_id", named.alias("__status"), F.lit(True).alias("__patched"),
        *[given(c).alias(f"__{c}") for c in ("notes", "customer_id", "base_price", "reservation_date", "customer_email")],
        *[T.blank_to_null(given(c)).alias(f"__{c}") for c in ("customer_name", "customer_phone")],
    )
    live = active_bookings(bookings).select("plot_id", F.col("booking_id").alias("__active"))
    price = F.coalesce(F.col("__base_price").cast("decimal(18,2)"), F.col("base_price").cast("decimal(18,2)"))
    state = plots.join(good, "plot_id", "left").join(live, "plot_id", "left").withColumn("__state", F.coalesce("__status", F.upper("status"))).withColumn("__price", price)
    touched = F.coalesce("__patched", F.lit(False))
    made_id = F.sha2(F.concat_ws("|", F.lit("direct"), F.col("plot_id").cast("string"), as_of.cast("string")), 256)
    opens = touched & F.col("__state").isin("SOLD", "BOOKED") & F.col("__active").isNull()
    frees = touched & (F.col("__state") == "AVAILABLE")
    dated = F.col("__reservation_date").cast("string")
    fields = {
        "status": F.coalesce("__status", "status"),
        "notes": F.coalesce("__notes", "notes") if "notes" in plots.columns else None,
        "base_price": F.coalesce(F.col("__base_price").cast(plots.schema["base_price"].dataType), "base_price"),
        "customer_id": F.when(frees, F.lit(None)).when(opens, made_id).when(F.col("__customer_id").isNotNull(), T.blank_to_null(F.col("__customer_id"))).otherwise(F.col("customer_id")),
        "reservation_date": F.when(frees, F.lit(None)).when(opens, as_of).when(dated.isNull(), F.col("reservation_date")).when(F.trim(dated) != "", F.coalesce(F.try_to_timestamp(dated), as_of)),
    }
    new_plots = state.select(*[fields[c].alias(c) if fields.get(c) is not None else F.col(c) for c in plots.columns])
    worth = F.coalesce(F.nullif(F.col("__price"), F.lit(0)), F.lit(K.DEFAULT_DIRECT_TOTAL)).cast("decimal(18,2)")
    opened = state.filter(opens).select(
        made_id.alias("booking_id"), "project_id", "plot_id",
        F.coalesce("__customer_name", F.lit("Customer")).alias("customer_name"),
        F.coalesce("__customer_phone", F.lit("N/A")).alias("customer_phone"),
        T.blank_to_null(F.col("__customer_email")).alias("customer_email"),
        worth.alias("total_amount"), worth.alias("booking_amount"), worth.alias("paid_amount"),
        F.lit(0).cast("decimal(18,2)").alias("remaining_amount"),
        F.lit("PAID").alias("payment_status"), F.lit("DIRECT").alias("payment_method"),
        F.lit("BOOKED").alias("booking_status"), as_of.alias("booking_date"), as_of.alias("created_at"),
    )
    decided = state.filter(touched).select("plot_id", "__state", "__customer_name", "__customer_phone", "__customer_email")
    held = bookings.join(decided, "plot_id", "left").join(live.select(F.col("__active").alias("booking_id"), F.lit(True).alias("__is_active")), "booking_id", "left")
    contact = F.col("__state").isin("SOLD", "BOOKED") & F.col("__is_active")
    mail = F.when(F.col("__customer_email").isNotNull(), T.blank_to_null(F.col("__customer_email"))).otherwise(F.col("customer_email"))
    changes = {
        "booking_status": F.when((F.col("__state") == "AVAILABLE") & (F.col("booking_status") == "BOOKED"), "CANCELLED").otherwise(F.col("booking_status")),
        "customer_name": F.when(contact, F.coalesce("__customer_name", "customer_name")).otherwise(F.col("customer_name")),
        "customer_phone": F.when(contact, F.coalesce("__customer_phone", "customer_phone")).otherwise(F.col("customer_phone")),
        "customer_email": F.when(contact, mail).otherwise(F.col("customer_email")),
    }
    kept = held.select(*[changes[c].alias(c) if c in changes else F.col(c) for c in bookings.columns])
    return new_plots, kept.unionByName(opened, allowMissingColumns=True)

"""Business recommendations from a forecast, by rule, for all series at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.numeric import fixed
from panelcast.operators.metrics import forecast_volatility, market_trend, peak_trough

# The texts of each rule as (category, level, title, description, actions). {pct} is
# the change in percent, {abs} its size, {peak} and {day} the value and day of the peak, {vol} the
# volatility in percent.
TEXTS = (
    ("Revenue", "high_growth", "Accelerate Growth ({pct}% Projected)",
     "Strong upward trajectory. Increase marketing budget by 15-20%, expand product lines, and "
     "prioritize digital advertising to capitalize on momentum.",
     ["Increase ad budget 15-20%", "Launch influencer partnerships", "Expand product lines"]),
    ("Revenue", "moderate_growth", "Capitalize on {pct}% Growth",
     "Positive trend ahead. Gradually increase ad spend by 10%, optimize conversion funnels, and "
     "prepare inventory for 15% higher demand.",
     ["Gradual ad spend increase (10%)", "Optimize conversion funnels",
      "Prepare 15% more inventory"]),
    ("Revenue", "high_decline", "Urgent: Address {abs}% Decline",
     "Significant drop predicted. Launch flash sales (20-30% off), implement loyalty rewards, and "
     "increase social media engagement.",
     ["Flash sales (20-30% off)", "Loyalty rewards program", "Email campaigns"]),
    ("Revenue", "moderate_decline", "Mitigate {abs}% Decline",
     "Sales expected to decrease. Create limited-time offers, increase customer retention "
     "efforts, and offer exclusive deals to loyal customers.",
     ["Limited-time offers", "Customer retention focus", "Exclusive deals for loyal customers"]),
    ("Revenue", "stable", "Maintain Steady Growth",
     "Stable forecast indicates consistent performance. Focus on customer retention and "
     "operational efficiency.",
     ["Customer retention focus", "Operational cost optimization", "Incremental upselling"]),
    ("Inventory", "peak_ahead", "Stock-up for Peak ({day})",
     "Maximum demand of {peak} expected. Ensure 20% safety stock is available 3-5 days before "
     "this peak.",
     ["Order 25% extra stock 2 weeks ahead", "Ensure popular SKUs stocked",
      "Coordinate priority shipping"]),
    ("Marketing", "schedule", "Optimized Ad Scheduling",
     "Run high-impact ads 48 hours before peak ({day}). Scale back during troughs to save budget.",
     ["Run ads 48-72hrs before peak", "Focus on high-intent audiences",
      "Schedule email promotions"]),
    ("Operations", "high_vol", "Dynamic Staffing Required",
     "High volatility ({vol}%) detected. Use flexible part-time staffing to match fluctuating "
     "daily demand.",
     ["Flexible staffing needed", "Use part-time for peaks", "Cross-train employees"]),
    ("Operations", "low_vol", "Fixed Staffing Efficiency",
     "Low volatility indicates predictable demand. Optimize full-time schedules to minimize "
     "overtime costs.",
     ["Optimize full-time schedules", "Minimize overtime costs", "Performance incentives"]),
    ("Pricing", "high_demand", "Premium Pricing Opportunity",
     "Strong demand allows for value-based pricing. Consider premium tiers and reduce discounting "
     "to maximize revenue.",
     ["Value-based pricing", "Premium product tiers", "Reduce discounts"]),
    ("Pricing", "low_demand", "Competitive Pricing Response",
     "Declining demand requires strategic pricing. Implement tiered discounts and loyalty-based "
     "pricing to maintain market share.",
     ["Tiered discounts", "Loyalty-based pricing", "Maintain market share"]),
    ("Pricing", "stable", "Stable Pricing Strategy",
     "Consistent demand supports stable pricing. Focus on value-added services and occasional "
     "promotions.",
     ["Value-added services", "Occasional promotions", "Monitor competitors"]),
    ("Risk", "high_risk", "Implement Risk Mitigation",
     "High-variance forecast detected. Diversify product portfolio, maintain 3-month cash "
     "reserves, and establish backup suppliers.",
     ["Diversify portfolio", "3-month cash reserves", "Backup suppliers ready"]),
    ("Risk", "low_risk", "Maintain Risk Monitoring",
     "Stable forecast allows for standard risk management. Continue regular monitoring and "
     "maintain safety stock levels.",
     ["Regular monitoring", "Maintain safety stock", "Quarterly risk review"]),
)


def text_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(TEXTS),
        "category string, level string, title string, description string, actions array<string>",
    )


def outlook_facts(series: DataFrame, forecast: DataFrame) -> DataFrame:
    """Change, peak and volatility of each series."""
    trend = market_trend(series, forecast)
    pct = F.when(F.col("avg_hist") > 0, F.col("pct")).otherwise(F.lit(0.0))
    return (
        trend.select("series_key", pct.alias("pct"))
        .join(peak_trough(forecast), "series_key")
        .join(forecast_volatility(forecast), "series_key")
    )


def rule_levels(as_of: Column) -> list[tuple[str, Column]]:
    """The level each category reaches; null leaves the category out."""
    pct, vol = F.col("pct"), F.col("volatility")
    return [
        ("Revenue", F.when(pct > 10, "high_growth").when(pct > 5, "moderate_growth")
         .when(pct < -10, "high_decline").when(pct < -5, "moderate_decline").otherwise("stable")),
        ("Inventory", F.when(F.date_diff("peak_ds", as_of) > 0, "peak_ahead")),
        ("Marketing", F.lit("schedule")),
        ("Operations", F.when(vol > 0.2, "high_vol").otherwise("low_vol")),
        ("Pricing", F.when(pct > 10, "high_demand").when(pct < -5, "low_demand")
         .otherwise("stable")),
        ("Risk", F.when((vol > 0.2) | (F.abs(pct) > 10), "high_risk").otherwise("low_risk")),
    ]


def _fill(template: str) -> Column:
    values = {
        "{pct}": fixed(F.col("pct"), 1),
        "{abs}": fixed(F.abs("pct"), 1),
        "{vol}": fixed(F.col("volatility") * 100, 1),
        "{peak}": F.format_number("peak", 0),
        "{day}": F.date_format("peak_ds", "dd MMM"),
    }
    text = F.col(template)
    for mark, value in values.items():
        text = F.replace(text, F.lit(mark), value)
    return text


def insight_rules(series: DataFrame, forecast: DataFrame, as_of: Column) -> DataFrame:
    """Up to six recommendations per series.

    ``as_of`` is the date the advice is given on; the stock rule fires only for a later peak.
    """
    levels = F.array(*[
        F.struct(F.lit(c).alias("category"), level.alias("level"))
        for c, level in rule_levels(as_of)
    ])
    hits = outlook_facts(series, forecast).withColumn("hit", F.explode(levels)).where(
        F.col("hit.level").isNotNull()
    )
    hits = hits.withColumn("category", F.col("hit.category")).withColumn("level", F.col("hit.level"))
    return (
        hits.join(F.broadcast(text_table(series.sparkSession)), ["category", "level"])
        .select("series_key", "category", "level", _fill("title").alias("title"),
                _fill("description").alias("description"), "actions")
    )

"""The recipe whose log, replay and reports the catalog queries."""

from colprep.plans.recipe import Recipe

SURVEY_RECIPE = (
    Recipe(column_types={"age": "continuous"})
    .append("income", "missing_values", "median_imputation", timestamp="2026-01-05T09:00:00")
    .append("age", "missing_values", "mean_imputation", timestamp="2026-01-05T09:05:00")
    .append("email", "missing_values", "missing_category", {"category_name": "Missing"}, timestamp="2026-01-05T09:10:00")
    .append("income", "outliers", "winsorization", {"lower_percentile": 5, "upper_percentile": 95}, timestamp="2026-01-05T09:15:00")
    .append("gender", "data_quality", "standardize_case", {"case_type": "lower"}, timestamp="2026-01-05T09:20:00")
    .append("phone", "missing_values", "mode_imputation", timestamp="2026-01-05T09:25:00")
    .append("title", "outliers", "winsorization", timestamp="2026-01-05T09:30:00")
)

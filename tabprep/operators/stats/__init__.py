"""Hypothesis tests, outliers and shape measures; ``by`` gives one result row per key."""

from tabprep.operators.stats.categorical import chi_square_goodness_of_fit, chi_square_independence
from tabprep.operators.stats.means import (
    group_statistics,
    levene,
    one_sample_ttest,
    one_way_anova,
    paired_ttest,
    tukey_pairs,
    two_sample_ttest,
)
from tabprep.operators.stats.normality import (
    anderson_darling,
    dagostino_pearson,
    normality,
    shapiro,
)
from tabprep.operators.stats.outliers import (
    iqr_bounds,
    iqr_outliers,
    iqr_report,
    skewness_kurtosis,
    zscore_outliers,
    zscore_report,
)
from tabprep.operators.stats.ranks import kruskal_wallis, mann_whitney_u, wilcoxon_signed_rank

__all__ = [
    "anderson_darling",
    "chi_square_goodness_of_fit",
    "chi_square_independence",
    "dagostino_pearson",
    "group_statistics",
    "iqr_bounds",
    "iqr_outliers",
    "iqr_report",
    "kruskal_wallis",
    "levene",
    "mann_whitney_u",
    "normality",
    "one_sample_ttest",
    "one_way_anova",
    "paired_ttest",
    "shapiro",
    "skewness_kurtosis",
    "tukey_pairs",
    "two_sample_ttest",
    "wilcoxon_signed_rank",
    "zscore_outliers",
    "zscore_report",
]

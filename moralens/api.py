"""The public functions in one place."""

from moralens.operators.balancing import apply_balancing, oversample, smote, undersample
from moralens.operators.bivariate import anova, bivariate_report, chi_square, mutual_information, target_type
from moralens.operators.cleaning import drop_duplicates, recategorize
from moralens.operators.columns import classify, select_classes
from moralens.operators.correlation import correlation_matrix
from moralens.operators.metrics import best_result, binary_metrics, confusion_matrix, leaderboard, roc_points
from moralens.operators.models import fit_model, linear_contributions, score
from moralens.operators.outliers import box_statistics, outlier_counts, outlier_rows, without_outliers
from moralens.operators.preparation import (
    create_preprocessor,
    feature_names,
    imputation_flags,
    impute_with_flags,
    manual_preprocessing,
)
from moralens.operators.quality import summary_statistics
from moralens.operators.selection import (
    cross_validate,
    evaluate_features,
    feature_importance,
    recursive_elimination,
    select_features,
)
from moralens.operators.splitting import add_folds, split_data
from moralens.plans.eda import eda_report
from moralens.plans.reports import average_payers, top_clients
from moralens.plans.training import (
    evaluate_model,
    prepare,
    preprocess_data,
    run,
    train_and_evaluate_models,
    train_balanced_models,
)
from moralens.sources.readers import load_data, validate_dataframe
from moralens.sources.sinks import load_model, save_model, write_csv, write_json

__all__ = [name for name in dir() if not name.startswith("_")]

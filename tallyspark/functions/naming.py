"""Names of metrics as people write them, mapped to the catalogue by columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The catalogue, accepted names, split words and keyword rules.
CATALOG = (
    "accuracy balanced_accuracy precision recall f1 roc_auc mcc cohen_kappa brier mse rmse mae r2 mean sum sharpe stdev variance sortino calmar information_ratio "
    "correlation ndcg mrr recall_at_k precision_at_k hit_at_k average_precision bleu rouge1 rouge2 rouge_l"
).split()
_NAMES = """
accuracy: acc accuracy_score top1 top-1
balanced_accuracy: balanced_accuracy_score bacc
roc_auc: auc auroc roc_auc_score auc_roc
f1: f1_score f1-score f_score fscore
precision: precision_score
recall: recall_score
mse: mean_squared_error
rmse: root_mean_squared_error
mae: mean_absolute_error
r2: r2_score r^2 rsquared r_squared
mean: average avg
sharpe: sharpe_ratio sr
mcc: matthews_corrcoef matthews mcc_score
cohen_kappa: cohen_kappa_score kappa cohens_kappa
brier: brier_score brier_score_loss
stdev: std std_dev stddev standard_deviation
variance: var_
sortino: sortino_ratio
calmar: calmar_ratio
information_ratio: info_ratio
correlation: corr pearson pearsonr pearson_correlation pearson_r
ndcg: ndcg_score ndcg@k ndcg@10 normalized_dcg
mrr: mean_reciprocal_rank reciprocal_rank
recall_at_k: recall@k recall_at recall@10
precision_at_k: precision@k precision_at
hit_at_k: hit@k hit_rate hits@k
average_precision: map mean_average_precision ap average_precision_score
bleu: bleu_score sacrebleu sentence_bleu corpus_bleu
rouge1: rouge-1 rouge_1
rouge2: rouge-2 rouge_2
rouge_l: rougel rouge-l rougelsum
"""
ALIASES = {alias: name for line in _NAMES.strip().splitlines() for name, rest in [line.split(": ")] for alias in rest.split()}
LEARNED = "bertscore bert_score bertscore_f1 bleurt comet comet_score moverscore bartscore prism unieval gptscore".split()
SPLITS = "test testing val valid validation holdout heldout eval dev oos train training".split()
SPLIT_NAMES = {"testing": "test", "valid": "val", "validation": "val", "heldout": "holdout", "training": "train"}
KEYWORDS = [
    ("roc auc", "roc_auc"),
    ("auroc", "roc_auc"),
    ("auc", "roc_auc"),
    ("balanced acc", "balanced_accuracy"),
    ("accuracy", "accuracy"),
    ("acc", "accuracy"),
    ("macro f1", "f1"),
    ("micro f1", "f1"),
    ("f1", "f1"),
    ("fscore", "f1"),
    ("precision", "precision"),
    ("recall", "recall"),
    ("rmse", "rmse"),
    ("mae", "mae"),
    ("mse", "mse"),
    ("r2", "r2"),
    ("rsquared", "r2"),
    ("sharpe", "sharpe"),
    ("mcc", "mcc"),
    ("matthews", "mcc"),
    ("brier", "brier"),
    ("cohen kappa", "cohen_kappa"),
    ("kappa", "cohen_kappa"),
    ("spearman", "spearman"),
    ("ndcg", "ndcg"),
]

BY_NAME, BY_KEYWORD = 0.9, 0.6


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def canonical(name: Column) -> Column:
    """The catalogue's name, or null."""
    key = F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit("_"))
    return _lookup({n: n for n in CATALOG} | {a: n for a, n in ALIASES.items()}, key)


def learned(name: Column) -> Column:
    """Whether the metric is a neural one that has no independent recomputation."""
    return F.coalesce(F.replace(F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_")).isin(LEARNED), F.lit(False))


def map_metric(name: Column) -> Column:
    """Struct (metric, split, confidence): by name, else by the first rule whose words all occur."""
    raw = F.lower(F.trim(name))
    words = F.filter(F.split(raw, "[^a-z0-9]+"), lambda w: w != "")
    split = F.get(F.filter(words, lambda w: w.isin(SPLITS)), F.lit(0))
    core = F.filter(words, lambda w: ~w.isin(SPLITS))
    named = F.coalesce(canonical(F.array_join(core, "_")), canonical(raw))
    rules = [F.when(F.size(F.array_except(F.array(*[F.lit(k) for k in keys.split()]), core)) == 0, metric) for keys, metric in KEYWORDS]
    guess = F.coalesce(*rules)
    return F.struct(
        F.coalesce(named, guess).alias("metric"),
        F.when(named.isNotNull() | guess.isNotNull(), F.coalesce(_lookup(SPLIT_NAMES, split), split)).alias("split"),
        F.when(named.isNotNull(), BY_NAME).when(guess.isNotNull(), BY_KEYWORD).otherwise(0.0).alias("confidence"),
    )

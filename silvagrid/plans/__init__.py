"""Multi-job plans: training, boosting, prediction, evaluation."""

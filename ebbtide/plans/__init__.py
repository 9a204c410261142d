"""Multi-step jobs: model fits over folds, drift filters, stacking, calibration, portfolios."""

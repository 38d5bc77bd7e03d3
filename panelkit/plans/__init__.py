"""Multi-step workflows: the feature catalogue, temporal splits, panel build and model runs."""

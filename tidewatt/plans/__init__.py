"""Multi-step plans: cleaning, pipelines, forecasting."""

"""Analytics for model-evaluation studies, as DataFrame-to-DataFrame functions."""

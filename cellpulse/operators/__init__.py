"""DataFrame-in, DataFrame-out operators: change detection, profiles, spatial, features, quality, model."""

"""Text features, classifiers, cross-validation and outcome prediction with Spark ML."""

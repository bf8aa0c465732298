"""Operators on clouds, images, series, diagrams, graphs and Mapper covers: DataFrame in, DataFrame out."""

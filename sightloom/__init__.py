"""sightloom: a Spark-native evidence analytics engine for captioned video segments."""

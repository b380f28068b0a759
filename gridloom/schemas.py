"""Declared schemas of the nested inputs."""

GRID = "array<array<int>>"
PAIR = f"struct<input:{GRID},output:{GRID}>"
TASK = f"struct<name:string,train:array<{PAIR}>,test:array<{PAIR}>>"
PREDICTIONS = f"map<string,array<map<string,{GRID}>>>"
CANDIDATE = f"struct<solver:string,grid:{GRID}>"
DECLARED_INPUT = "struct<role:string,path:string,sha256:string>"
RULE = "struct<glob:string,tier:string,reason:string>"
FILE_RECORD = "struct<role:string,path:string,sha256:string,bytes:bigint,required_for_claim:boolean>"
METRIC = "struct<name:string,role:string,numerator:double,denominator:double,value:double,top_k:int>"
WITNESS = "struct<d4:string,color:map<int,int>,train_permutation:array<int>,test_permutation:array<int>>"
